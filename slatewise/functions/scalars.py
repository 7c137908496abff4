"""Scalar functions of media lineage, Column to Column; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds, their priorities and limits.
IMAGE_EXTENSIONS = ["bmp", "gif", "heic", "jpeg", "jpg", "pdf", "png", "svg", "tif", "tiff", "webp"]
EXTENSION_PRIORITY = {"svg": 0, "pdf": 1, "png": 2, "jpg": 3, "jpeg": 3, "tiff": 4, "tif": 4}
OTHER_PRIORITY = 5
MIME_TYPES = {"svg": "image/svg+xml", "pdf": "application/pdf", "png": "image/png", "webp": "image/webp", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
QUALITIES = ["xml_exact", "exact", "strong", "review", "poor", "no_match"]
PREVIEW = r"(?i)^(st|mt)-[0-9A-Fa-f-]+-\d+\.(png|jpe?g|tiff?|gif|bmp|webp)$"
ASPECT_LIMIT = 1.1
AHASH_LIMIT = 25
NEAR_AHASH = 2
COMPANION_WINDOW = 3
CONFIRMED_PHASH = 16


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^./]+$", "")


def strip_id(name: Column) -> Column:
    """Without a trailing -digits."""
    return F.regexp_replace(name, r"-\d+$", "")


def drop_id(name: Column) -> Column:
    """Without what follows the last -, if that is digits or nothing."""
    return F.regexp_replace(name, r"-\d*$", "")


def trailing_id(name: Column) -> Column:
    """Number after the last -, null without one or beyond 64 bits."""
    return F.nullif(F.regexp_extract(name, r"-(\d+)$", 1), F.lit("")).try_cast("bigint")


def slide_number(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"slide(\d+)\.xml\.rels$", 1), F.lit("")).try_cast("int")


def is_image(path: Column) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def is_preview(name: Column) -> Column:
    return name.contains("-small-") | name.rlike(PREVIEW)


def is_template(path: Column) -> Column:
    return F.lower(path).contains("templateslide")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def moment_distance(a: Column, b: Column) -> Column:
    """L2 distance; infinite for different lengths or a null, 0 for two empty arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).otherwise(float("inf")).cast("float")


def aspect_gate(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """True unless both ratios are known and differ by more than ASPECT_LIMIT."""
    known = (w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0)
    r1, r2 = w1 / F.nullif(h1, F.lit(0)), w2 / F.nullif(h2, F.lit(0))
    return ~F.coalesce(known, F.lit(False)) | F.coalesce(F.greatest(r1, r2) / F.least(r1, r2) <= ASPECT_LIMIT, F.lit(True))


def extension_priority(ext: Column) -> Column:
    out = F.when(F.lit(False), OTHER_PRIORITY)
    for k, v in EXTENSION_PRIORITY.items():
        out = out.when(ext == k, v)
    return out.otherwise(OTHER_PRIORITY)


def replacement_kind(ext: Column) -> Column:
    return F.when(ext == "svg", "svg").when(ext == "pdf", "pdf").otherwise("raster")


def quality(phash: Column, structural: Column) -> Column:
    """Class of the top candidate's pHash distance; null has none."""
    return (
        F.when(structural & (phash == 0), "exact")
        .when(structural & (phash < CONFIRMED_PHASH), "xml_exact")
        .when(phash == 0, "exact")
        .when(phash < 8, "strong")
        .when(phash < 16, "review")
        .when(phash <= 25, "poor")
        .otherwise("no_match")
    )


def quality_ordinal(q: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, QUALITIES)), q).cast("int") - 1


def quality_label(q: Column) -> Column:
    return F.when(q == "xml_exact", "XML exact").when(q == "no_match", "No match").otherwise(F.initcap(q))


def distance_band(d: Column) -> Column:
    return F.when(d >= 64, "hidden").when(d == 0, "exact").when(d < 8, "near").when(d < 16, "close").otherwise("far")


def default_choice(structural_name: Column, structural_phash: Column, top_name: Column, top_phash: Column) -> Column:
    """The structural match if near enough, else the first candidate if near enough, else skip."""
    return F.when(structural_phash < CONFIRMED_PHASH, structural_name).when(top_phash < CONFIRMED_PHASH, top_name).otherwise("skip")


def points_per_unit(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u == "pt", 96 / 72).when(u == "mm", 72 / 25.4).when(u == "cm", 72 / 2.54).when(u == "in", 72.0).otherwise(1.0)


def dimension_value(text: Column) -> Column:
    """Leading number of a length, 0 for a bad one."""
    return F.coalesce(F.regexp_extract(F.trim(text), r"^([0-9.-]+)", 1).try_cast("double"), F.lit(0.0))


def dimension_unit(text: Column) -> Column:
    u = F.lower(F.regexp_replace(F.trim(text), r"^[0-9.-]+", ""))
    return F.when(u == "", "px").otherwise(u)


def svg_x(transform: Column, x: Column) -> Column:
    """x of a text: the fifth number of matrix(), the first of translate(), or the attribute."""
    number = r"\s*(-?[0-9.]+)"
    matrix = F.regexp_extract(transform, r"matrix\(" + rf"(?:{number}\s*[, ]){{4}}".replace("(-", "(?:-") + number, 1)
    translate = F.regexp_extract(transform, r"translate\(" + number, 1)
    return F.coalesce(matrix.try_cast("double"), translate.try_cast("double"), x.try_cast("double"))


def viewbox(text: Column) -> Column:
    """Numbers of a viewBox; width and height are the third and fourth."""
    return F.filter(F.split(text, "[, ]+"), lambda p: p.try_cast("double").isNotNull())


def pair_confidence(delta: Column, has_text: Column, jaccard: Column, ratio: Column) -> Column:
    """Confidence that a vector file and a page are one drawing."""
    match = delta < 2
    base = F.when(match, 0.5).otherwise(F.greatest(F.lit(0.0), 0.5 - delta / 100))
    with_text = base + 0.35 * jaccard + 0.15 * ratio
    without = F.when(match, F.least(base + 0.3, F.lit(0.8))).otherwise(base)
    return F.least(F.when(has_text, with_text).otherwise(without), F.lit(1.0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def word_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def output_extension(ext: Column, degraded_ext: Column, mode: str) -> Column:
    """Extension of what replaces a degraded file, by the patch mode."""
    vector = ext.isin("svg", "pdf")
    made = {"vector_in_place": ext, "embed_png": F.lit("png"), "embed_webp_75": F.lit("webp")}[mode]
    return F.when(vector, made).otherwise(degraded_ext)


def mime_type(ext: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in MIME_TYPES.items():
        out = out.when(ext == k, v)
    return out.otherwise("application/octet-stream")


def dpi_for_width(width: Column, visible_width: Column) -> Column:
    return width / F.nullif(visible_width, F.lit(0)) * 72


def fit(side: Column, longest: Column, limit: int, upscale: bool) -> Column:
    """A side scaled so that the longest is limit, at least 1; rasters are not scaled up."""
    scale = F.lit(float(limit)) / longest
    if not upscale:
        scale = F.least(F.lit(1.0), scale)
    return F.greatest(F.lit(1), F.floor(side * scale).cast("int"))


def visible_part(crop: Column, media: Column, crop_other: Column, same: Column) -> Column:
    """A side of the crop box if that is larger than 1 x 1 and differs from the media box, else the media box's."""
    return F.when((crop > 1) & (crop_other > 1) & ~same, crop).otherwise(media)


def inject_overflow(svg: Column) -> Column:
    """overflow="hidden" on the root element unless it has an overflow."""
    return F.when(~svg.contains("<svg") | svg.contains("overflow"), svg).otherwise(F.regexp_replace(svg, r"^((?s).*?<svg[^>]*?)(/?>)", '$1 overflow="hidden"$2'))


def slide_label(slides: Column) -> Column:
    """"Slide 3" or "Slides 1, 2"."""
    return F.when(F.size(slides) == 0, "No slide").otherwise(
        F.concat(F.when(F.size(slides) == 1, "Slide ").otherwise("Slides "), F.array_join(F.transform(slides, lambda s: s.cast("string")), ", "))
    )


def byte_count(size: Column) -> Column:
    """"999 bytes", "12 KB", "3.4 MB": decimal units, one place from MB up."""
    return (
        F.when(size < 1000, F.concat(size.cast("string"), F.when(size == 1, " byte").otherwise(" bytes")))
        .when(size < 1_000_000, F.concat(F.round(size / 1000).cast("bigint").cast("string"), F.lit(" KB")))
        .when(size < 1_000_000_000, F.concat(F.format_number(size / 1_000_000, 1), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(size / 1_000_000_000, 2), F.lit(" GB")))
    )


def hex_hash(hash: Column) -> Column:
    """A 64-bit hash as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(hash), 16, "0"))
