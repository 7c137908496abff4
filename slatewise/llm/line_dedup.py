"""Line dedup over overlapping windows of three consecutive lines.

Every three consecutive lines of a document are a window. Windows are hashed (two 64-bit hashes) and
counted over all documents; of windows with equal lines the first, by doc_id and then line, stays
and every later one marks its three lines. A document loses the union of its marked lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import bound, id_key, saved, table, without_spaces

WINDOW = 3


def _lines(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """_key, _text_hash and the sorted positions of lines to remove, for documents that lose some.

    Windows without a word don't count. Documents of under three lines have no window. A row that
    comes twice with the same doc_id and text has equal windows at equal places: both rows stay.
    """
    base = docs.select(id_key(F.col("doc_id")).alias("_key"), F.xxhash64("text").alias("_text_hash"), _lines(F.col("text")).alias("_lines"))
    base = base.where(F.size("_lines") >= WINDOW)
    triples = bound(
        F.col("_lines"),
        lambda lines: F.transform(
            F.sequence(F.lit(1), F.size(lines) - (WINDOW - 1)), lambda i: F.array_join(F.slice(lines, i, F.lit(WINDOW)), "\n")
        ),
    )
    rows = base.select("_key", "_text_hash", F.posexplode(triples).alias("_at", "_window"))
    rows = rows.where(F.length(without_spaces(F.col("_window"))) > 0)
    rows = rows.select("_key", "_text_hash", "_at", F.xxhash64("_window").alias("_h1"), F.xxhash64(F.lit(WINDOW), F.col("_window")).alias("_h2"))
    # written, so that the join below has a plain exchange on both sides and Spark can split a window that very many documents hold
    first = saved(
        rows.groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_key", "_text_hash", "_at")).alias("_first"))
        .where("_n > 1")
        .select("_h1", "_h2", "_first")
    )
    later = rows.join(first, ["_h1", "_h2"]).where(F.struct("_key", "_text_hash", "_at") > F.col("_first"))
    covered = later.groupBy("_key", "_text_hash").agg(F.collect_set("_at").alias("_starts"))
    spans = F.flatten(F.transform("_starts", lambda p: F.sequence(p, p + (WINDOW - 1))))
    return covered.select("_key", "_text_hash", F.array_distinct(spans).alias("_removed"))


def _deduplicated(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text (what is kept), n_lines, n_removed of each row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("text").alias("own"), id_key(F.col("doc_id")).alias("_key"), F.xxhash64("text").alias("_text_hash"))
    joined = keyed.join(repeated_lines(docs), ["_key", "_text_hash"], "left")
    lines = _lines(F.col("own"))
    kept = bound(
        lines,
        lambda own: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("_removed")), lambda i: F.element_at(own, i + 1)), "\n"
        ),
    )
    return joined.select(
        "row",
        F.when(F.col("_removed").isNull(), F.col("own")).otherwise(kept).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs with text replaced by its kept lines, plus n_lines and n_removed.

    A null text stays null and has one empty line, as an empty one has. Where nothing is removed the
    text is unchanged. Input columns named n_lines or n_removed are replaced, all others stay as they
    are, whatever their names. An empty table gives no rows; ties go to the smaller doc_id, then to the
    smaller hash of the text, then to the earlier line.
    """
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _deduplicated(docs).select(*[(F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in others], "n_lines", "n_removed")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with the kept lines as text and its length as n_chars, where docs has that.

    A row whose lines have all gone, or all but empty ones, is a copy of earlier text from end to end and
    goes. Rows that lose no line stay as they are, null and empty texts among them.
    """
    out = _deduplicated(docs).where((F.col("n_removed") == 0) | (F.length(without_spaces(F.col("text"))) > 0))

    def column(c: str) -> F.Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row")[c]).cast(docs.schema[c].dataType)
        return F.col("row")[c]

    return out.select([column(c).alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines() over all documents."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP8_SQL = """
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, i AS pos, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS win
  FROM (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 0))) AS i FROM l)
), f AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM w
  WHERE regexp_matches(win, '[^\\x20\\x09-\\x0D]')
), r AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM f WHERE n > 1
), e AS (
  SELECT doc_id, len(lines) AS n_lines, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM l
)
SELECT e.doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, count(r.pos) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY e.pos) FILTER (WHERE r.pos IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.pos = r.pos GROUP BY e.doc_id
"""
