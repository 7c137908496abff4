"""Reachability over the object graph of a package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise import shared

#: Rounds whose nodes are one table; more are put together.
ROUNDS = 16


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut from its lineage in the shared folder."""
    shared.folder(df.sparkSession)
    return df.checkpoint()


def reachable(roots: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """(slide_no, node) of all nodes that each slide's root reaches, itself included; (package, slide_no, node) where all inputs have a package.

    roots: slide_no, node. edges: src, dst. blocked: node; template nodes are neither entered nor left.
    Nodes without edges are leaves; cycles end the search, as what is seen is not entered again.
    """
    return expanded(reached_sets(roots, edges, blocked), roots.schema["slide_no"].dataType.simpleString())


def reached_sets(roots: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """(package,) node, word, bits: slides 64 * word + i of each set bit i reach the node. A row may come in parts, which share no bit.

    A node is a row for each 64 slides, not for each slide. A round is one join of the frontier with the edges, and one sum of
    bits with all that is seen: what it adds is the next frontier, and all that is written.
    """
    own = [c for c in ("package",) if c in roots.columns]
    at = [*own, "node", "word"]
    closed = blocked.select(*own, "node").distinct()
    open_edges = edges.select(*own, "src", "dst").distinct().join(closed.withColumnRenamed("node", "dst"), [*own, "dst"], "left_anti").withColumnRenamed("src", "node")
    slide = F.col("slide_no").cast("bigint")
    bit = F.expr("shiftleft(1L, CAST(CAST(slide_no AS BIGINT) & 63 AS INT))")
    first = roots.where("slide_no IS NOT NULL").select(*own, "node", F.shiftright(slide, 6).alias("word"), bit.alias("bits")).join(closed, [*own, "node"], "left_anti")
    seen = [_checkpointed(first.groupBy(*at).agg(F.bit_or("bits").alias("bits")))]
    while not seen[-1].isEmpty():
        following = seen[-1].join(open_edges, [*own, "node"]).select(*own, F.col("dst").alias("node"), "word", F.col("bits").alias("new"), F.lit(0).cast("bigint").alias("old"))
        before = _all(seen).select(*at, F.lit(0).cast("bigint").alias("new"), F.col("bits").alias("old"))
        both = following.unionByName(before).groupBy(*at).agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        fresh = F.col("new").bitwiseAND(F.bitwise_not("old"))
        seen.append(_checkpointed(both.select(*at, fresh.alias("bits")).where("bits <> 0")))
        if len(seen) > ROUNDS:
            seen = [_checkpointed(_all(seen[:-1]).groupBy(*at).agg(F.bit_or("bits").alias("bits"))), seen[-1]]
    return _all(seen)


def expanded(sets: DataFrame, kind: str = "bigint") -> DataFrame:
    """(package,) slide_no, node of reached_sets()."""
    own = [c for c in ("package",) if c in sets.columns]
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return sets.select(*own, "node", "word", F.explode(bits).alias("i")).select(*own, (F.col("word") * 64 + F.col("i")).cast(kind).alias("slide_no"), "node")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def slide_assets(reached: DataFrame, data_edges: DataFrame) -> DataFrame:
    """data_ref, slides, and package where both have it: the sorted slides whose reached nodes refer to a data file. data_edges: obj, data_ref."""
    own = [c for c in ("package",) if c in reached.columns]
    joined = reached.join(data_edges.withColumnRenamed("obj", "node"), [*own, "node"])
    return joined.groupBy(*own, "data_ref").agg(F.sort_array(F.collect_set("slide_no")).alias("slides"))
