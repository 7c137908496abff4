"""Substring dedup by De Bruijn compaction over words.

Nodes are sequences of WINDOW - 1 words, edges are windows of WINDOW words; an edge is the pair of its
nodes. Spans of windows (repeats.py) leave out what can't repeat, and equal spans are counted once, so that
only one copy of each different span is read again and gives its edges, with the count of its copies:

1. Edges are summed over spans; those that are found twice are the repeated ones, each with the first of
   its source coordinates, which names it.
2. Nodes are met by both their sides: one with one repeated edge in and one out is nonbranching and
   joins the two. Joins that go on in one source document compact to segments, the others glue
   segments: chains of glued segments are paths, found as connected components by joins (passages()).
3. Each place of a repeated edge repeats the edge's first source coordinates. Places that go on along one
   document are long spans; the words of both ends are read at their source coordinates and have to agree.

What deduplicated() removes follows from the repeated edges and their source coordinates alone, and for
spans that are found twice as a whole from their first place: it makes the segments, but its rows would be
the same without them. Only passages() depends on how edges compact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.llm.common import discard, saved, table
from slatewise.llm.components import components
from slatewise.llm.repeats import Prefix, agrees, based, compared, covered, mix, small, spans_found, symbols_of, units, until_agreed, whole_places

WINDOW = 35
GRAM = 8


def edges(base: DataFrame, spans: DataFrame, branching: DataFrame, k: int, seed: int) -> DataFrame:
    """u, v, c, key, th, at: the edges of one copy of each span that is found twice or whose minimizer branches, c copies each."""
    wanted = spans.where("c > 1").select("first", "n", "c").unionByName(spans.where("c = 1").join(branching, "mini").select("first", "n", "c"))
    per = wanted.groupBy("first.key", "first.th").agg(F.collect_list(F.struct("first.at", "n", "c")).alias("own"))
    symbols = symbols_of(False, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 100):
            values, begun = symbols(batch.column(2))
            hashed = Prefix(values)
            lists = batch.column(3)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at, n, c = (lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            key, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low in range(0, len(doc), 1 << 13):
                some = slice(low, low + (1 << 13))
                which = np.repeat(np.arange(low, low + len(doc[some])), n[some])
                inner = np.arange(len(which)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                place = at[which] + inner
                start = begun[doc[which]] + place
                u, v = (mix(hashed.of(x, k - 1)) for x in (start, start + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(c[which]), pa.array(key[doc[which]]), pa.array(th[doc[which]]), pa.array(place)], ["u", "v", "c", "key", "th", "at"]
                )

    return base.join(per, ["key", "th"]).select("key", "th", "text", "own").mapInArrow(run, "u bigint, v bigint, c bigint, key bigint, th bigint, at bigint")


def repeated_edges(all_edges: DataFrame) -> DataFrame:
    """u, v, c, src: the edges that are found twice, with the first of their source coordinates (key, th, at)."""
    return all_edges.groupBy("u", "v").agg(F.sum("c").alias("c"), F.min(F.struct("key", "th", "at")).alias("src")).where("c > 1")


def joined_edges(repeated: DataFrame) -> DataFrame:
    """a, b: the edge into and the edge out of each node that has one of each."""
    sides = repeated.select(F.col("v").alias("node"), F.col("src").alias("into"), F.lit(None).cast(repeated.schema["src"].dataType).alias("out_of"))
    sides = sides.unionByName(repeated.select(F.col("u").alias("node"), F.lit(None).cast(repeated.schema["src"].dataType).alias("into"), F.col("src").alias("out_of")))
    met = sides.groupBy("node").agg(F.count("into").alias("i"), F.count("out_of").alias("o"), F.min("into").alias("a"), F.min("out_of").alias("b"))
    return met.where("i = 1 AND o = 1").select("a", "b")


def segments(repeated: DataFrame, joins: DataFrame) -> DataFrame:
    """u, v, c, src, head: each repeated edge with the edge at the head of its segment, which goes on in one source document."""
    going_on = (F.col("a.key") == F.col("b.key")) & (F.col("a.th") == F.col("b.th")) & (F.col("a.at") + 1 == F.col("b.at"))
    inner = joins.where(going_on).select(F.col("b").alias("src"), F.lit(True).alias("inner"))
    marked = repeated.join(inner, "src", "left")
    of_document = Window.partitionBy("src.key", "src.th").orderBy("src.at")
    return marked.withColumn("head", F.max(F.when(F.col("inner").isNull(), F.col("src"))).over(of_document)).drop("inner")


def passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """n_words, copies, doc_id, at of each repeated path: its length, the least count of its windows, and the source coordinates of its first segment.

    Null and empty texts hold none; rows that share an id or come twice are as in deduplicated().
    """
    base = based(docs)
    _, spans, branching = spans_found(base, False, window, gram, 0)
    repeated = saved(repeated_edges(edges(base, spans, branching, window, 0)))
    joins = saved(joined_edges(repeated))
    cut = saved(segments(repeated, joins))
    per = saved(cut.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.max("src").alias("last")))
    # a join that doesn't go on in its document leads from the last edge of a segment to the head of another
    glue = joins.join(per.select(F.col("last").alias("a"), F.col("head").alias("from_head")), "a").join(per.select(F.col("head").alias("b")), "b")
    found = components(glue.select(F.col("from_head").alias("a"), "b"))
    placed = per.join(found, per["head"] == found["node"], "left").withColumn("path", F.coalesce("component", "head"))
    out = placed.groupBy("path").agg((F.sum("n") + window - 1).alias("n_words"), F.min("c").alias("copies"))
    ids = docs.schema["doc_id"].dataType.simpleString()
    key = F.col("path.key")
    return out.select("n_words", "copies", F.when(key != -(2**63), key).cast(ids).alias("doc_id"), F.col("path.at").alias("at"))


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row, and kept (the kept words joined by spaces) if texts.

    Null and empty texts have no words and lose none, and texts of fewer words than a window lose none. A row
    that comes twice is two documents: both lose their windows. An empty table gives no rows. Other columns
    are not looked at.
    """
    base = based(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, wrong boolean" + ", kept string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n_words, n_removed, kept, hashes, wrong = [], [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                own, spans = units(text.as_py(), False), spans.as_py() or []
                gone = covered(len(own), spans, window)
                n_words.append(len(own))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(own, gone.tolist()) if not g] if spans else own))
                hashes.append(hashlib.sha256(kept[-1]).hexdigest())
                wrong.append(not agrees(own, spans, window))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(hashes, pa.string()), pa.array(wrong, pa.bool_())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "wrong"]
            if texts:
                columns.append(pa.array([x.decode() for x in kept], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    def attempt(seed: int) -> DataFrame:
        found, spans, branching = spans_found(base, False, window, gram, seed)
        every = saved(edges(base, spans, branching, window, seed), sweep=True)
        repeated = saved(repeated_edges(every), sweep=True)
        joins = saved(joined_edges(repeated), sweep=True)
        cut = saved(segments(repeated, joins), sweep=True)
        discard(repeated, joins)
        # what only one copy of a branching span holds repeats its edge's place on the path
        late = every.where("c = 1").join(cut, ["u", "v"]).select(every["key"], every["th"], every["at"], F.lit(1).alias("n"), F.col("src.key").alias("rkey"), F.col("src.th").alias("rth"), F.col("src.at").alias("rat"))
        places = whole_places(found, spans, keep_first=False).unionByName(late)
        out = compared(base, places, False, window).mapInArrow(run, schema)
        return out

    return until_agreed(attempt)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deduplicated() over all documents."""
    return deduplicated(table(spark, sf_dir, "documents"), texts=False)


OP1_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM s) WHERE n > 1
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r
), e AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), k AS (
  SELECT e.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
