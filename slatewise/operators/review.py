"""Review of the mapping: filters, bulk edits, overrides and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S


def first_candidate() -> Column:
    return F.try_element_at("candidates", F.lit(1))


def reviewed(mapping: DataFrame) -> DataFrame:
    """mapping with view: exact (the first candidate's aHash is equal), needs_review, confirmed or other."""
    view = (
        F.when(F.coalesce(first_candidate()["ahash_distance"] == 0, F.lit(False)), "exact")
        .when((F.col("choice") == "skip") & (F.size("candidates") > 0), "needs_review")
        .when(F.col("choice") != "skip", "confirmed")
        .otherwise("other")
    )
    return mapping.withColumn("view", view)


def confirm_all(mapping: DataFrame, visible: Column) -> DataFrame:
    """Skipped rows that are visible and have a candidate take the first."""
    return mapping.withColumn("choice", F.when(visible & (F.col("choice") == "skip") & (F.size("candidates") > 0), first_candidate()["name"]).otherwise(F.col("choice")))


def overridden(mapping: DataFrame, overrides: DataFrame) -> DataFrame:
    """Choices replaced by the last override of each item, and custom_url. overrides: degraded, seq, choice, url.

    An override with a url chooses a file of the user's own, by its name. Without a url column there are none.
    """
    url = F.col("url") if "url" in overrides.columns else F.lit(None).cast("string")
    chosen = F.struct(F.when(url.isNotNull(), S.basename(url)).otherwise(F.col("choice")).alias("choice"), url.alias("url"))
    last = overrides.groupBy("degraded").agg(F.max_by(chosen, "seq").alias("last"))
    joined = mapping.join(last, "degraded", "left")
    return joined.withColumn("choice", F.coalesce("last.choice", "choice")).withColumn("custom_url", F.col("last.url")).drop("last")


def summary(mapping: DataFrame) -> DataFrame:
    """One row: total, confirmed, skipped, how many replacements are vectors or rasters, and whether there is anything to apply."""
    ext = F.lower(F.regexp_extract("choice", r"\.([^./]+)$", 1))
    on = F.col("choice") != "skip"
    return mapping.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(on).alias("confirmed"),
        F.count_if(~on).alias("skipped"),
        F.count_if(on & ext.isin("svg", "pdf")).alias("vectors"),
        F.count_if(on & ~ext.isin("svg", "pdf")).alias("rasters"),
        (F.count_if(on) > 0).alias("can_apply"),
    )


def retained(sessions: DataFrame, keep: int = 10) -> DataFrame:
    """Sessions to delete: all but the newest ``keep`` of each owner, or of all without an owner column. sessions: owner, id, created.

    Without owners each task keeps its newest alone, the newest of those give one threshold, and sessions before it are what is left. Of
    sessions created at once those with greater ids are newer. Sessions without a date are neither kept nor deleted.
    """
    dated = sessions.where("created IS NOT NULL")
    if "owner" in sessions.columns:
        newest_first = Window.partitionBy("owner").orderBy(F.desc("created"), F.desc_nulls_last("id"))
        return dated.withColumn("n", F.row_number().over(newest_first)).where(F.col("n") > keep).drop("n")
    newest = dated.select("created", "id").orderBy(F.desc("created"), F.desc_nulls_last("id")).limit(keep)
    threshold = newest.agg(F.min(F.struct("created", "id"))).scalar()
    return dated.where(F.struct("created", "id") < threshold)


def debug_json(mapping: DataFrame, slides: DataFrame | None = None) -> DataFrame:
    """degraded, json: the row as ground truth for later runs, with the stale score that older files carry as legacy_score.

    slides: degraded, slides (the numbers of its slides); items that it lacks have [].
    """
    mapping = mapping.join(slides, "degraded", "left") if slides is not None else mapping.withColumn("slides", F.lit(None).cast("array<bigint>"))
    candidates = F.transform(
        "candidates",
        lambda c: F.struct(
            c["ahash_distance"].alias("ahash_distance"),
            F.when(c["score"] < float("inf"), (c["score"] - c["phash_distance"]) / 20).alias("cm_distance"),
            F.when(c["score"] < float("inf"), c["score"]).alias("combined_score"),
            F.when(c["score"] < float("inf"), c["ahash_distance"] + (c["score"] - c["phash_distance"]) / 4).alias("legacy_score"),
            c["name"].alias("name"),
            c["phash_distance"].alias("phash_distance"),
            (c["name"] == F.col("choice")).alias("user_confirmed"),
        ),
    )
    row = F.struct(candidates.alias("candidates"), F.col("choice").alias("confirmed_match"), F.col("degraded").alias("filename"), F.col("is_structural").alias("is_xml_exact"), "quality", F.coalesce("slides", F.array().cast("array<bigint>")).alias("slides"))
    return mapping.select("degraded", F.to_json(row).alias("json"))
