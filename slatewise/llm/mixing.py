"""Mixing sources to target weights by capped water-filling.

A level is raised over all sources at once, each rising by its weight, until the levels hold the
whole budget; a source stops at ``max_epochs`` times its own size and what it can't take is shared
by the others in proportion to their weights. With sources in order of cap / weight, the level that
fits is the largest of (budget - caps before) / (weights from here on), so no loop is needed.

A source whose target is e times its size repeats each document floor(e) times; the fraction that is
left is sampled: documents are dealt into strata of some 256 by a seeded hash, ordered by size in
each, and every 1/fraction-th is taken once more. Strata keep a source with a third of all rows from
meeting in one task, and the order by size keeps the words taken near the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.llm.common import id_key, mixed, mixed_sql, saved, table, words

STRATUM = 256
SEED = 7


def source_targets(sized: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target of each source of (source, size) rows.

    Sources by code point, null last, weigh 1, 2, 3, repeating. An empty table gives no rows; where
    all sizes are 0 all targets are 0. The windows here run in one task, over one row a source: some
    hundred bytes each, so that millions of sources fit.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = ranked.withColumn("level", level)
    best = F.max("level").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(max_epochs * F.col("source_size"), F.col("weight") * best).cast("double")
    return levels.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (whole repetitions taken) of each document.

    Null texts have size 0; a null doc_id is an id like any other; repeated rows are documents of
    their own, taken as often as their own turn in the sample says. An empty table gives no rows. Only
    ids, sources and sizes are moved, never texts.
    """
    sized = saved(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")))
    return _mixed(sized, max_epochs, seed)


def _mixed(sized: DataFrame, max_epochs: float, seed: int) -> DataFrame:
    """sized (doc_id, source, size and what it carries) with source_size, target and copies."""
    targets = source_targets(sized, max_epochs).withColumnRenamed("source", "its_source")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["its_source"])).drop("its_source")
    carried = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    key = id_key(F.col("doc_id"))
    stratum = mixed(key, seed) % F.ceil(F.col("n_docs") / STRATUM)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = joined.withColumn("stratum", stratum).withColumn("epochs", epochs)
    order = Window.partitionBy("source", "stratum").orderBy("size", mixed(key, seed + 1), "doc_id")
    start = mixed(F.col("stratum"), seed + 2) / float(1 << 31)
    fraction = F.col("epochs") - F.floor("epochs")
    n = F.row_number().over(order)
    ranked = dealt.withColumn("n", n)
    extra = F.floor(fraction * F.col("n") + start) - F.floor(fraction * (F.col("n") - 1) + start)
    return ranked.select("doc_id", "source", "size", "source_size", "target", (F.floor("epochs") + extra).cast("long").alias("copies"), *carried)


def mixed_documents(docs: DataFrame, max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """The mixture itself: each row of docs, all columns as they are, as many times as the mix takes it.

    A row carries its own number of copies through the strata, so that repeated rows, shared or missing
    ids and sources of any name stay apart. Nulls and empty tables are as in mix().
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), row)
    taken = _mixed(sized, max_epochs, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() over all documents, with the words taken."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


_K = "coalesce(doc_id, -9223372036854775807 - 1)"
OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM per
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ranked
), targets AS (
  SELECT source AS its_source, source_size, n_docs, CAST(least(3.0::DOUBLE * source_size, weight * max(level) OVER ()) AS DOUBLE) AS target FROM levels
), dealt AS (
  SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS epochs,
    {mixed_sql(_K, SEED)} % CAST(ceil(n_docs / {STRATUM}) AS BIGINT) AS stratum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.its_source
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY size, {mixed_sql(_K, SEED + 1)}, doc_id) AS n,
    {mixed_sql("stratum", SEED + 2)} / {float(1 << 31)}::DOUBLE AS start, epochs - floor(epochs) AS fraction FROM dealt
), copied AS (
  SELECT *, CAST(floor(epochs) + floor(fraction * n + start) - floor(fraction * (n - 1) + start) AS BIGINT) AS copies FROM numbered
)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM copied
"""
