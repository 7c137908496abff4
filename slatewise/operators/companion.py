"""Companion files: a PDF rendering that was exported next to an SVG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S


def candidates(items: DataFrame) -> DataFrame:
    """svg, pdf, gap: PDFs of an SVG's stem whose id is at most COMPANION_WINDOW lower. items: filename, stem, id, ext."""
    svg = items.where("ext = 'svg'").select("stem", F.col("filename").alias("svg"), F.col("id").alias("svg_id"))
    pdf = items.where("ext = 'pdf'").select("stem", F.col("filename").alias("pdf"), F.col("id").alias("pdf_id"))
    # the window as an equi-join too: an SVG looks up the ids below its own, so that a stem of many files is no group
    looked = svg.withColumn("pdf_id", F.explode(F.sequence(F.col("svg_id") - S.COMPANION_WINDOW, F.col("svg_id") - 1)))
    return looked.join(pdf, ["stem", "pdf_id"]).select("svg", "pdf", (F.col("svg_id") - F.col("pdf_id")).alias("gap"))


#: Confidence from which a PDF counts as an SVG's rendering, and how far the places of a word may differ, as a share of the width.
CONFIDENT, X_NEAR = 0.65, 0.02


def validated(found: DataFrame, drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """found (svg, pdf, gap) with delta, overlap, x_matches, x_total, confidence and is_pair.

    drawings: as svg.metrics() gives them. pages: filename, width, height, words array<struct<text, x_min>>, the first
    page of each PDF. A PDF without a page has confidence 0; an SVG without metrics has no size and no text.
    """
    positive = lambda c, other: F.when(c > 0, c).otherwise(other)
    side = lambda c: F.coalesce(c, F.lit(0.0))
    span = positive(positive(side(F.col("vb_width")), side(F.col("width"))), F.lit(1.0))
    d = drawings.select(
        F.col("filename").alias("svg"),
        (side(F.col("width")) * S.points_per_unit(F.coalesce("width_unit", F.lit("px")))).alias("d_width"),
        (side(F.col("height")) * S.points_per_unit(F.coalesce("height_unit", F.lit("px")))).alias("d_height"),
        F.array_distinct(F.flatten(F.transform("texts", lambda t: S.words_of(t["content"])))).alias("drawn"),
    )
    p = pages.select(
        F.col("filename").alias("pdf"), F.col("width").alias("p_width"), F.col("height").alias("p_height"), F.lit(True).alias("readable"),
        F.array_distinct(F.filter(F.transform("words", lambda w: w["text"]), lambda w: w != "")).alias("printed"),
    )
    # each text starts with a word and each word of a page has a first place: both lists are made once a file and meet by the word
    starts = drawings.select(F.col("filename").alias("svg"), span.alias("d_span"), F.explode("texts").alias("t"))
    starts = starts.select("svg", F.try_element_at(S.words_of(F.col("t.content")), F.lit(1)).alias("word"), (F.col("t.x") / F.col("d_span")).alias("x")).where("word IS NOT NULL AND x IS NOT NULL")
    printed = pages.select(F.col("filename").alias("pdf"), positive(F.col("width"), F.lit(1.0)).alias("span"), F.posexplode("words").alias("at", "w"))
    firsts = printed.groupBy("pdf", F.col("w.text").alias("word")).agg(F.min_by(F.col("w.x_min") / F.col("span"), "at").alias("place")).where("place IS NOT NULL")
    near = F.abs(F.col("x") - F.col("place")) < X_NEAR
    met = found.select("svg", "pdf").distinct().join(starts, "svg").join(firsts, ["pdf", "word"])
    placed = met.groupBy("svg", "pdf").agg(F.count_if(near).cast("int").alias("x_matches"), F.count(F.lit(1)).cast("int").alias("x_total"))

    joined = found.join(d, "svg", "left").join(p, "pdf", "left").join(placed, ["svg", "pdf"], "left").fillna(0, ["x_matches", "x_total"])
    none = F.array().cast("array<string>")
    drawn, printed_words = F.coalesce("drawn", none), F.coalesce("printed", none)
    sized = (side(F.col("d_width")) > 0) & (F.col("p_width") > 0)
    delta = F.when(sized, F.greatest(F.abs(F.col("d_width") - F.col("p_width")), F.abs(F.col("d_height") - F.col("p_height")))).otherwise(float("inf"))
    made = joined.select(
        *found.columns, "readable", delta.alias("delta"), S.word_jaccard(drawn, printed_words).alias("overlap"), (F.size(drawn) + F.size(printed_words) > 0).alias("has_text"), "x_matches", "x_total"
    )
    ratio = F.when(F.col("x_total") > 0, F.col("x_matches") / F.col("x_total")).otherwise(0.0)
    confidence = F.when(F.col("readable"), S.pair_confidence(F.col("delta"), F.col("has_text"), F.col("overlap"), ratio)).otherwise(0.0)
    out = made.withColumn("confidence", confidence).withColumn("is_pair", F.col("confidence") >= CONFIDENT)
    return out.select(*found.columns, "delta", "overlap", "x_matches", "x_total", "confidence", "is_pair")


def pairs(found: DataFrame, valid: Column) -> DataFrame:
    """The nearest valid PDF of each SVG; one PDF may serve several."""
    nearest = Window.partitionBy("svg").orderBy("gap", "pdf")
    return found.where(valid).withColumn("n", F.row_number().over(nearest)).where("n = 1").drop("n")


#: What an SVG takes from its PDF.
BORROWED = ("ahash", "phash", "moments", "width", "height")


def absorbed(fingerprints: DataFrame, chosen: DataFrame) -> DataFrame:
    """Fingerprints in which an SVG has its PDF's hashes, moments and sizes, nulls included, and the PDFs used are gone.

    An SVG keeps its own where its PDF has no fingerprint; that PDF is used all the same. All else is the SVG's own.
    """
    lent = fingerprints.select(F.col("filename").alias("borrowed_from"), *[F.col(c).alias(f"b_{c}") for c in BORROWED])
    none = F.lit(None).cast("string")
    sides = F.explode(F.array(F.struct(F.col("svg").alias("filename"), F.col("pdf").alias("borrowed_from"), F.lit(False).alias("used")), F.struct(F.col("pdf").alias("filename"), none.alias("borrowed_from"), F.lit(True).alias("used"))))
    roles = chosen.select(sides.alias("r")).select("r.*").groupBy("filename").agg(F.max("borrowed_from").alias("borrowed_from"), F.max("used").alias("used"))
    joined = fingerprints.join(roles, "filename", "left").where("used IS NULL OR NOT used").drop("used")
    joined = joined.join(lent.withColumn("lends", F.lit(True)), "borrowed_from", "left")
    lends = F.col("lends").isNotNull()
    own = [F.when(lends, F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) if c in BORROWED else F.col(c) for c in fingerprints.columns]
    return joined.select(*own, F.when(lends, F.col("borrowed_from")).alias("borrowed_from"))


def export_companion(items: DataFrame) -> DataFrame:
    """The first PDF of an SVG's stem, whatever its id; used when a package is written."""
    pdf = items.where("ext = 'pdf'").groupBy("stem").agg(F.min("filename").alias("pdf"))
    return items.where("ext = 'svg'").join(pdf, "stem", "left").select(F.col("filename").alias("svg"), "pdf")
