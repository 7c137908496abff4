"""Exact top-k by inner product with block-at-a-time pruning.

Queries and rows are dealt into blocks by hashes of their own, and every block of queries meets every
block of rows in a task: a grid of bounded groups, in which no query vector passes through the driver.

The terms of a vector are its components. A task puts its rows in an order in which neighbours are
alike (it splits them again and again by the direction from one far row to another) and cuts them into
document ranges of RANGE rows, and these into pieces of PIECE rows; for each it keeps every term's
maximum and minimum. A query's bound for a range or piece is the sum of what each term can add at most.
Ranges are taken in order of falling bound. Only in a range that is opened are its pieces' bounds worked out, and those
pieces whose bound reaches the k-th best score so far are scored through their forward index (their rows as a matrix),
until the next range's bound is below the k-th score. Where pieces' bounds rule out fewer rows than they cost, ranges
are scored whole. At a bound equal to it scoring goes on, since a tie goes to the smaller id.

Each query is searched in one block first; what is found there is kept, and its k-th score is a floor that it takes
to all other blocks. Each task returns k rows a query at most; Spark ranks those of all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.llm.common import saved, table
from slatewise.shipping import ship

QUERIES = 4096
#: Components of a block of rows, on average, and the least number of its rows.
COMPONENTS = 1 << 21
LEAST_ROWS = 1 << 10
RANGE, PIECE = 64, 8
#: Pieces looked at before their bounds have to save more products than they cost.
ENOUGH = 64
STEP = 8
AT_ONCE = 128
EXACT = 2**53
HUGE = 1e300
LONG = 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double> of whole numbers) of the rows that take part: no null, no null or non-finite component."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    scaled = F.transform(x, lambda e: F.expr("1024.0D") * e.cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, floored; shorter ones are filled up with zeros, and what is huge stops at HUGE."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.clip(np.floor(column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]), -HUGE, HUGE)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond a long stop at its limits."""
    if np.abs(rows).max(initial=0) * np.abs(q).max(initial=0) * max(1, rows.shape[1]) < EXACT:
        return (rows @ q).astype(np.int64)
    whole = [int(x) for x in q]
    exact = (sum(int(a) * b for a, b in zip(r, whole)) for r in rows)
    return np.array([max(-LONG, min(LONG, x)) for x in exact], dtype=np.int64)


def alike(rows: np.ndarray) -> np.ndarray:
    """An order of rows in which neighbours are alike: halves by the direction between two far rows, down to pieces."""
    done, todo = [], [np.arange(len(rows))]
    while todo:
        own = todo.pop()
        if len(own) <= PIECE:
            done.append(own)
            continue
        own_rows = rows[own]
        far = own_rows[np.argmin(own_rows @ own_rows[0])]
        along = own_rows @ (far - own_rows[np.argmin(own_rows @ far)])
        size = RANGE if len(own) > RANGE else PIECE
        half = max(size, len(own) // 2 // size * size)
        order = np.argpartition(along, half)
        todo += [own[order[half:]], own[order[:half]]]
    return np.concatenate(done) if done else np.empty(0, np.int64)


class Search:
    """Top k of each query over the blocks of rows that it is given. floors: scores that the k-th best is known to reach."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.floors = np.full(len(ids), -LONG, np.int64) if floors is None else floors
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]  # scores, ids: best first
        self.scored = np.zeros(len(ids), np.int64)
        self.products = np.zeros(len(ids), np.int64)  # of whole vectors, those for bounds among them

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(ids):
            return
        with np.errstate(all="ignore"):
            order = alike(rows)
            ids, rows = ids[order], rows[order]
            ranges, pieces = ((np.maximum.reduceat(rows, at, axis=0), np.minimum.reduceat(rows, at, axis=0)) for at in (np.arange(0, len(ids), n) for n in (RANGE, PIECE)))
            for at in range(0, len(self.ids), AT_ONCE):
                some = self.queries[at : at + AT_ONCE]
                bounds = upper(np.maximum(some, 0), np.minimum(some, 0), *ranges)
                for i in range(len(some)):
                    self._search(at + i, ids, rows, bounds[i], pieces)

    def _search(self, i: int, ids: np.ndarray, rows: np.ndarray, bounds: np.ndarray, pieces: tuple[np.ndarray, np.ndarray]) -> None:
        scores, held = self.found[i]
        query = self.queries[i]
        parts = np.maximum(query, 0)[None], np.minimum(query, 0)[None]
        falling = np.argsort(-bounds, kind="stable")
        self.products[i] += 2 * len(bounds)
        looked = ruled_out = 0
        for at in range(0, len(falling), STEP):
            kth = max(self.floors[i], scores[-1] if len(scores) == self.k else -LONG)
            some = falling[at : at + STEP]
            some = some[bounds[some] >= kth]
            if not len(some):
                break
            inside = (some[:, None] * (RANGE // PIECE) + np.arange(RANGE // PIECE)).ravel()
            inside = inside[inside < len(pieces[0])]
            if kth > -LONG and (looked < ENOUGH or ruled_out * PIECE >= 2 * looked):
                self.products[i] += 2 * len(inside)
                looked += len(inside)
                near = upper(*parts, pieces[0][inside], pieces[1][inside])[0] >= kth
                ruled_out += int((~near).sum())
                inside = inside[near]
            inside = (inside[:, None] * PIECE + np.arange(PIECE)).ravel()
            inside = inside[inside < len(ids)]
            self.scored[i] += len(inside)
            self.products[i] += len(inside)
            got = products(rows[inside], query)
            use = (ids[inside] != self.ids[i]) & (got >= kth)
            s, h = np.concatenate([scores, got[use]]), np.concatenate([held, ids[inside][use]])
            best = np.lexsort((h, -s))[: self.k]
            scores, held = s[best], h[best]
        self.found[i] = (scores, held)


def upper(above: np.ndarray, below: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Bounds of blocks of rows for queries: their positive parts take the terms' maxima and their negative ones the minima."""
    b = above @ most.T + below @ least.T
    # bounds of very large numbers are rounded: a little is added so that they stay bounds
    return np.nan_to_num(b + np.abs(b) * 1e-12, nan=np.inf)


def _met(queries: pa.Table, rows: pa.Table, k: int) -> Search:
    """The search of a block of queries (vec_id, v and perhaps floor) in a block of rows."""
    vectors = [t.column("v").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64())) for t in (queries, rows)]
    width = max(1, *(int(np.diff(v.offsets.to_numpy()).max(initial=0)) for v in vectors))
    floors = queries.column("floor").to_numpy() if "floor" in queries.column_names else None
    search = Search(queries.column("vec_id").to_numpy(), matrix(vectors[0], width), k, floors)
    search.add(rows.column("vec_id").to_numpy(), matrix(vectors[1], width))
    return search


def _searches(vectors: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """The first search of each query and those of the grid's other cells, as rows of _SEARCHED."""
    ship(vectors.sparkSession)
    rows = usable(vectors)
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).head()
    row_blocks = max(1, -(-n // max(LEAST_ROWS, COMPONENTS // max(1, width or 1))), min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS))
    query_blocks = max(1, -(-asked // QUERIES))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
    dealt = rows.withColumn("r", F.pmod(F.xxhash64("vec_id", "v"), F.lit(row_blocks)).cast("int"))

    def searched(queries: pa.Table, rows: pa.Table) -> pa.Table:
        search = _met(queries, rows, k)
        ends = np.cumsum([0] + [len(h) for _, h in search.found])
        scores, held = (pa.array(np.concatenate([np.empty(0, np.int64), *(f[i] for f in search.found)]), pa.int64()) for i in (0, 1))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (scores, held)]
        counts = [pa.array(x, pa.int64()) for x in (search.scored, search.products, np.full(len(search.ids), rows.num_rows))]
        return queries.select(["vec_id", "v", "q"]).append_column("scores", lists[0]).append_column("held", lists[1]).append_column("scored", counts[0]).append_column("products", counts[1]).append_column("rows", counts[2])

    # each block of queries is searched in one block of rows first, and blocks of rows go to the queries that start with them
    blocks = lambda name, size, keep: F.explode(F.expr(f"filter(sequence(0, {size - 1}), {name} -> {keep})")).alias(name)
    own = dealt.select("vec_id", "v", blocks("q", query_blocks, f"q % {row_blocks} = r"))
    first = saved(queries.groupBy("q").cogroup(own.groupBy("q")).applyInArrow(searched, _SEARCHED))
    floor = F.when(F.size("scores") == k, F.element_at("scores", -1)).otherwise(-LONG)
    others = first.select("vec_id", "v", floor.alias("floor"), "q", blocks("r", row_blocks, f"q % {row_blocks} <> r"))
    grid = dealt.select("vec_id", "v", "r", blocks("q", query_blocks, f"q % {row_blocks} <> r"))
    return first, others.groupBy("q", "r").cogroup(grid.groupBy("q", "r")).applyInArrow(searched, _SEARCHED)


_SEARCHED = "vec_id bigint, v array<double>, q int, scores array<bigint>, held array<bigint>, scored bigint, products bigint, rows bigint"


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each vector whose id is divisible by every.

    Vectors that are null or hold nulls or non-finite components are neither queries nor candidates.
    Lengths may differ: what is missing counts as 0. Of repeated rows each is a candidate; a query's own
    id is none of its candidates, and an id is one query, with the first of its vectors by value. Scores
    beyond a long stop at its limits. An empty table, or one without queries, gives no rows.
    """
    first, others = _searches(vectors, k, every)
    found = first.unionByName(others).select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("scores", F.col("held").alias("ids"))).alias("x"))
    found = found.select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pairs_scored(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, scored, products, rows of each search: rows scored, products of whole vectors made for scores and bounds, and rows there."""
    first, others = _searches(vectors, k, every)
    return first.unionByName(others).select(F.col("vec_id").alias("query_id"), "scored", "products", "rows")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k() over all embeddings."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
