"""The engine's input tables over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_EXT = "CASE p_partkey % 6 WHEN 0 THEN 'svg' WHEN 1 THEN 'pdf' WHEN 2 THEN 'png' WHEN 3 THEN 'jpg' WHEN 4 THEN 'tiff' ELSE 'gif' END"


def _fp(shift, xor, brand) -> str:
    one = lambda x: shift("1", x)
    ahash = xor(
        "(b * b * b * 500000000000003)",
        f"CASE pk % 4 WHEN 0 THEN 0 WHEN 1 THEN {one('pk % 61')} WHEN 2 THEN {xor(one('pk % 61'), one('(pk * 7) % 61'))} ELSE {shift('255', 'pk % 50')} END",
    )
    return f"""
SELECT pk, concat('p', pk, '.', ext) AS filename, CASE WHEN pk % 5 = 0 THEN 'degraded' ELSE 'source' END AS side, ext,
  CASE WHEN pk % 17 <> 0 THEN h END AS ahash, CASE WHEN pk % 13 <> 0 THEN {xor('h', shift('5', 'pk % 40'))} END AS phash,
  CASE WHEN pk % 19 <> 0 THEN ARRAY[CAST(pk % 7 AS DOUBLE), CAST(b AS DOUBLE), CAST(pk % 5 AS DOUBLE)] END AS moments,
  CASE WHEN pk % 23 <> 0 THEN 100 + 10 * p_size END AS width, 100 + 25 * (pk % 9) AS height
FROM (SELECT *, {ahash} AS h FROM (SELECT p_partkey AS pk, p_size, {_EXT} AS ext, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS b FROM {brand}))"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints from parts, with nulls of every kind; every fifth is degraded, the others are sources."""
    sql = _fp(lambda a, n: f"shiftleft({a}L, CAST({n} AS INT))", lambda a, b: f"({a} ^ {b})", "{part}")
    return spark.sql(sql.replace("ARRAY[", "array(").replace("AS DOUBLE)]", "AS DOUBLE))"), part=table(spark, sf_dir, "part"))


FP_SQL = "fp AS (" + _fp(lambda a, n: f"(CAST({a} AS BIGINT) << ({n}))", lambda a, b: f"xor({a}, {b})", "part").replace("ARRAY[", "[") + ")"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fp = fingerprints(spark, sf_dir)
    return fp.where("side = 'degraded'"), fp.where("side = 'source'")


_FN = """SELECT doc_id, lang AS stem, doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'svg' WHEN doc_id % 3 = 0 THEN 'png' ELSE 'pdf' END AS ext,
  concat(lang, '-', doc_id, '.', CASE WHEN doc_id % 2 = 0 THEN 'svg' WHEN doc_id % 3 = 0 THEN 'png' ELSE 'pdf' END) AS filename, n_chars, source, text FROM {documents}"""


def filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FN, documents=table(spark, sf_dir, "documents"))


FN_SQL = "fn AS (" + _FN.format(documents="documents") + ")"

_MEMBERS = """SELECT conv_id AS slide_no, CASE WHEN role = 'user' THEN 'degraded' ELSE 'source' END AS side,
  CASE WHEN role = 'user' THEN concat('d', conv_id % 97, '-', turn, '.png')
    ELSE concat('s', conv_id % 89, '-', turn, CASE WHEN turn % 2 = 0 THEN '.pdf' ELSE '.svg' END) END AS filename FROM {conversations}"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on slides from conversations: a conversation is a slide, user turns are degraded items."""
    return spark.sql(_MEMBERS, conversations=table(spark, sf_dir, "conversations"))


MEMBERS_SQL = "membership AS (" + _MEMBERS.format(conversations="conversations") + ")"


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationship targets from pages: (slide_no, target)."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("slide_no"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


HREFS_SQL = "hrefs AS (SELECT page_id AS slide_no, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages)"

_DECK = """SELECT side, filename, CAST((pk - pk % 5) / 5 AS BIGINT) AS slide_no FROM {fp} WHERE (pk % 5 = 0 AND pk % 11 <> 0) OR (pk % 5 = 1 AND pk % 3 <> 0) OR (pk % 5 = 2 AND pk % 7 = 0)
  UNION ALL SELECT side, filename, CAST(pk / 5 + 1 AS BIGINT) AS slide_no FROM {fp} WHERE pk % 30 = 0"""


def deck(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items, prints, membership of parts: some items without a fingerprint or slide, some slides with two sources, some sources claimed twice."""
    fp = fingerprints(spark, sf_dir)
    prints = fp.where("pk % 29 <> 0").select("side", "filename", "ahash", "phash", "moments", "width", "height")
    return fp.select("side", "filename", F.col("pk").alias("seq")), prints, spark.sql(_DECK, fp=fp)


DECK_SQL = "prints AS (SELECT * FROM fp WHERE pk % 29 <> 0), deck AS (" + _DECK.format(fp="fp") + ")"
