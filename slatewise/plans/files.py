"""Queries of names, packages, companions, the object graph and sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise import shared
from slatewise.functions import scalars as S
from slatewise.operators import companion, graph, keyed, patch, review
from slatewise.plans.fixtures import FN_SQL, HREFS_SQL, filenames, hrefs, table
from slatewise.sources import archive, package, zips


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return p.select("page_id", S.basename(F.col("path")).alias("basename"), S.stem(F.col("path")).alias("stem"), S.extension(F.col("path")).alias("ext"))


_ENDINGS = ("-12", "-", "--7", "-a7", "-3-44", "", "-5x", " -9", "7")


def strip_id(spark: SparkSession, d: str) -> DataFrame:
    fn = filenames(spark, d)
    name = F.concat("stem", F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int")))
    return fn.select("doc_id", S.strip_id(S.stem(F.col("filename"))).alias("plain"), S.strip_id(name).alias("stripped"), S.drop_id(name).alias("dropped"))


def trailing_id(spark: SparkSession, d: str) -> DataFrame:
    fn = filenames(spark, d)
    long_name = F.concat(S.stem(F.col("filename")), F.lit("99999999999999999999"))
    name = F.concat("stem", F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int")))
    return fn.select("doc_id", S.trailing_id(S.stem(F.col("filename"))).alias("id"), S.trailing_id(name).alias("edge"), S.trailing_id(long_name).alias("too_long"))


def slide_number(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("ppt/slides/_rels/slide"), "page_id", F.when(F.col("page_id") % 3 == 0, ".xml").otherwise(".xml.rels"))
    return table(spark, d, "pages").select("page_id", S.slide_number(path).alias("slide_no"))


def _asset_name() -> F.Column:
    """Names of every kind from documents: previews, small variants, upper-case endings, other files."""
    i = F.col("doc_id")
    return (
        F.when(i % 7 == 0, F.concat(F.lit("st-"), F.lower(F.hex(i)), F.lit("-"), i, F.lit(".png")))
        .when(i % 7 == 1, F.concat("stem", F.lit("-small-"), i, F.lit(".jpg")))
        .when(i % 7 == 2, F.concat("stem", F.lit("-"), i, F.lit(".TIFF")))
        .when(i % 7 == 3, F.concat("stem", F.lit("-"), i, F.lit(".mov")))
        .otherwise(F.col("filename"))
    )


_ASSET = """CASE WHEN doc_id % 7 = 0 THEN 'st-' || lower(to_hex(doc_id)) || '-' || doc_id || '.png' WHEN doc_id % 7 = 1 THEN stem || '-small-' || doc_id || '.jpg'
  WHEN doc_id % 7 = 2 THEN stem || '-' || doc_id || '.TIFF' WHEN doc_id % 7 = 3 THEN stem || '-' || doc_id || '.mov' ELSE filename END"""
_PREVIEW = "(contains({0}, '-small-') OR regexp_matches(lower({0}), '^(st|mt)-[0-9a-f-]+-[0-9]+\\.(png|jpe?g|tiff?|gif|bmp|webp)$'))"
_IMAGE = "lower(regexp_extract({}, '\\.([^./]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'gif', 'tiff', 'tif', 'bmp', 'webp', 'svg', 'pdf', 'heic')"


def ext_whitelist(spark: SparkSession, d: str) -> DataFrame:
    fn = filenames(spark, d).withColumn("name", _asset_name())
    return fn.where(S.is_image(F.col("name"))).select("doc_id", "name")


def preview_filter(spark: SparkSession, d: str) -> DataFrame:
    return filenames(spark, d).withColumn("name", _asset_name()).where(~S.is_preview(F.col("name"))).select("doc_id", "name")


def template_flag(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("Index/"), F.when(F.col("doc_id") % 4 == 0, "TemplateSlide-").otherwise("Slide-"), F.col("doc_id"), F.lit(".iwa"))
    return table(spark, d, "documents").select("doc_id", S.is_template(path).alias("is_template"))


def dest_ext(spark: SparkSession, d: str) -> DataFrame:
    fn = filenames(spark, d)
    return fn.select("doc_id", *[S.output_extension(F.col("ext"), F.lit("jpg"), m).alias(m) for m in ("vector_in_place", "embed_png", "embed_webp_75")])


def mime_type(spark: SparkSession, d: str) -> DataFrame:
    return filenames(spark, d).select("doc_id", S.mime_type(S.extension(_asset_name())).alias("mime"))


def collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    rows = filenames(spark, d).select("doc_id", F.concat("stem", F.lit("-"), "source").alias("stem"), F.col("doc_id").alias("seq"))
    return patch.collision_names(rows).select("doc_id", "new_stem")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return filenames(spark, d).select("filename", "stem", "id", "ext")


def companion_candidates(spark: SparkSession, d: str) -> DataFrame:
    return companion.candidates(_items(spark, d))


_COMP = "comp AS (SELECT a.filename AS svg, b.filename AS pdf, a.id - b.id AS gap FROM fn a JOIN fn b ON a.ext = 'svg' AND b.ext = 'pdf' AND a.stem = b.stem AND b.id < a.id AND a.id - b.id <= 3)"
def _drawings(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the SVGs among the names: sizes from ids, every line of the document as a drawn text."""
    fn = filenames(spark, d).where("ext = 'svg'")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(((F.length(x) % 100) * 1.0).cast("double").alias("x"), F.trim(x).alias("content"))), lambda t: t["content"] != "")
    width = (100 + (F.col("id") - F.col("id") % 4) / 4).cast("double")
    return fn.select(
        "filename", width.alias("width"), F.when(F.col("id") % 20 == 0, "pt").otherwise("px").alias("width_unit"), F.lit(50.0).alias("height"), F.lit("px").alias("height_unit"),
        F.when(F.col("id") % 3 == 0, F.lit(200.0)).alias("vb_width"), F.lit(None).cast("double").alias("vb_height"), lines.alias("texts"),
    )


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """First pages of the PDFs among the names: every word of the document with a place; some can't be read."""
    fn = filenames(spark, d).where("ext = 'pdf' AND id % 7 <> 0")
    words = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.struct(w.alias("text"), ((F.length(w) % 50) * 1.0).cast("double").alias("x_min")))
    return fn.select("filename", (100 + (F.col("id") - F.col("id") % 4) / 4).cast("double").alias("width"), F.when(F.col("id") % 5 == 0, 53.0).otherwise(50.0).alias("height"), words.alias("words"))


# the three signals of a pair, by unnesting: sizes in points, overlap of words, places of the first word of each text
_PAIRS = """pg AS (SELECT filename AS pdf, 100 + (id - id % 4) / 4 AS p_width, CASE WHEN id % 5 = 0 THEN 53.0::DOUBLE ELSE 50.0::DOUBLE END AS p_height, string_split(coalesce(text, ''), ' ') AS w FROM fn WHERE ext = 'pdf' AND id % 7 <> 0)
, dr AS (SELECT filename AS svg, (100 + (id - id % 4) / 4) * CASE WHEN id % 20 = 0 THEN 96.0::DOUBLE / 72 ELSE 1.0::DOUBLE END AS d_width, CASE WHEN id % 3 = 0 THEN 200.0::DOUBLE ELSE 100 + (id - id % 4) / 4 END AS d_span,
  string_split(coalesce(text, ''), chr(10)) AS lines FROM fn WHERE ext = 'svg')
, j AS (SELECT comp.*, d_width, d_span, p_width, p_height, pg.pdf IS NOT NULL AS readable, lines, coalesce(w, []) AS w FROM comp JOIN dr USING (svg) LEFT JOIN pg USING (pdf))
, ow AS (SELECT svg, pdf, list_distinct(list_filter(flatten(list_transform(lines, lambda x: string_split(trim(x), ' '))), lambda x: x <> '')) AS sw, list_distinct(list_filter(w, lambda x: x <> '')) AS pw FROM j)
, ov AS (SELECT svg, pdf, len(list_intersect(sw, pw)) AS i, len(sw) + len(pw) AS n FROM ow)
, tx AS (SELECT svg, pdf, d_span, p_width, w, (length(line) % 100) * 1.0::DOUBLE AS x, list_filter(string_split(trim(line), ' '), lambda v: v <> '')[1] AS word FROM (SELECT *, unnest(lines) AS line FROM j WHERE readable))
, xm AS (SELECT svg, pdf, count(*) AS x_total, count(*) FILTER (WHERE abs(x / d_span - ((length(word) % 50) * 1.0::DOUBLE) / p_width) < 0.02::DOUBLE) AS x_matches FROM tx WHERE word IS NOT NULL AND list_contains(w, word) GROUP BY svg, pdf)
, sg AS (SELECT j.svg, j.pdf, j.gap, readable, CASE WHEN readable THEN greatest(abs(d_width - p_width), abs(50.0::DOUBLE - p_height)) ELSE CAST('inf' AS DOUBLE) END AS delta,
  CASE WHEN n > 0 THEN CAST(i AS DOUBLE) / (n - i) ELSE 0.0::DOUBLE END AS overlap, n > 0 AS has_text, coalesce(x_matches, 0) AS x_matches, coalesce(x_total, 0) AS x_total
  FROM j JOIN ov ON ov.svg = j.svg AND ov.pdf = j.pdf LEFT JOIN xm ON xm.svg = j.svg AND xm.pdf = j.pdf)
, bs AS (SELECT *, CASE WHEN delta < 2 THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, 0.5::DOUBLE - delta / 100) END AS base, CASE WHEN x_total > 0 THEN CAST(x_matches AS DOUBLE) / x_total ELSE 0.0::DOUBLE END AS ratio FROM sg)
, val AS (SELECT *, CASE WHEN NOT readable THEN 0.0::DOUBLE ELSE least(CASE WHEN has_text THEN base + 0.35::DOUBLE * overlap + 0.15::DOUBLE * ratio WHEN delta < 2 THEN least(base + 0.3::DOUBLE, 0.8::DOUBLE) ELSE base END, 1.0::DOUBLE) END AS confidence FROM bs)
, prs AS (SELECT svg, pdf, gap FROM (SELECT *, row_number() OVER (PARTITION BY svg ORDER BY gap, pdf) AS n FROM val WHERE confidence >= 0.65::DOUBLE) WHERE n = 1)"""


def companion_validate(spark: SparkSession, d: str) -> DataFrame:
    v = companion.validated(companion.candidates(_items(spark, d)), _drawings(spark, d), _pages(spark, d))
    return v.select("svg", "pdf", F.round("delta", 6).alias("delta"), F.round("overlap", 6).alias("overlap"), "x_matches", "x_total", F.round("confidence", 6).alias("confidence"), "is_pair")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    found = companion.validated(companion.candidates(_items(spark, d)), _drawings(spark, d), _pages(spark, d))
    return companion.pairs(found, F.col("is_pair")).select("svg", "pdf", "gap")


def companion_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def companion_absorb(spark: SparkSession, d: str) -> DataFrame:
    fn = filenames(spark, d).where("id % 13 <> 0")
    prints = fn.select("filename", F.col("n_chars").alias("size"), F.when(F.col("id") % 5 != 0, F.col("id") * 31).alias("ahash"), (F.col("id") * 17).alias("phash"),
                       F.array((F.col("id") % 7).cast("double")).alias("moments"), F.col("n_chars").alias("width"), (F.col("n_chars") % 100).alias("height"))
    out = companion.absorbed(prints, _pairs(spark, d))
    return out.select("filename", "size", "ahash", "phash", F.element_at("moments", 1).alias("moment"), "width", "height", "borrowed_from")


def export_companion(spark: SparkSession, d: str) -> DataFrame:
    return companion.export_companion(_items(spark, d))


def pair_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of documents that are two ids apart."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(other, "doc_id").select("doc_id", F.round(S.word_jaccard(S.words_of(F.col("text")), S.words_of(F.col("next"))), 6).alias("jaccard"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Words of each line with a place, for lines as drawn texts and the next document's words as the page's."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).select(
        "doc_id", "pos", F.try_element_at(S.words_of(F.col("line")), F.lit(1)).alias("word"), ((F.length("line") % 100) / 100.0).alias("x")
    )


def pair_x_match(spark: SparkSession, d: str) -> DataFrame:
    """Share of first words that the next document also starts a line with, nearly at the same place."""
    t = _texts(spark, d).where("word IS NOT NULL")
    page = t.groupBy((F.col("doc_id") - 1).alias("doc_id"), "word").agg(F.min_by("x", F.struct("x", "pos")).alias("page_x"))
    near = F.abs(F.col("x") - F.col("page_x")) < 0.02
    return t.join(page, ["doc_id", "word"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"), F.round(F.count_if(near) / F.count(F.lit(1)), 6).alias("ratio"))


def pair_confidence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    delta = F.abs((F.col("n_chars") % 100 - 50) / 10.0)
    jaccard, ratio = (F.col("doc_id") % 11) / 10.0, (F.col("doc_id") % 7) / 6.0
    c = S.pair_confidence(delta, F.col("doc_id") % 2 == 0, jaccard, ratio)
    return docs.select("doc_id", F.round(c, 6).alias("confidence"), (F.round(c, 6) >= 0.65).alias("is_pair"))


_UNITS = "element_at(array('px','pt','mm','cm','in','','em'), CAST(doc_id % 7 + 1 AS INT))"


def unit_to_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") * S.points_per_unit(F.expr(_UNITS)), 6).alias("points"))


def dimension_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.when(F.col("doc_id") % 9 == 0, "auto").when(F.col("doc_id") % 9 == 1, F.concat(F.lit("-"), "n_chars", F.lit(".5"))).otherwise(F.concat(F.col("n_chars"), F.lit(".5"))), F.upper(F.expr(_UNITS)))
    return table(spark, d, "documents").select("doc_id", S.dimension_value(text).alias("value"), S.dimension_unit(text).alias("unit"))


def viewbox_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("0 0,"), F.col("n_chars"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit(" "), F.col("doc_id"))))
    parts = S.viewbox(text)
    four = F.size(parts) >= 4
    return table(spark, d, "documents").select("doc_id", *[F.when(four, F.element_at(parts, i).cast("double")).alias(n) for i, n in ((3, "width"), (4, "height"))])


def svg_x(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    transform = F.when(i % 4 == 0, F.concat(F.lit("matrix(1 0 0 1 "), i, F.lit(".5 7)"))).when(i % 4 == 1, F.concat(F.lit("translate(-"), i, F.lit(", 3)"))).otherwise("")
    x = F.when(i % 4 == 2, i.cast("string")).otherwise("none")
    return table(spark, d, "documents").select("doc_id", S.svg_x(transform, x).alias("x"))


def rels_slide_media(spark: SparkSession, d: str) -> DataFrame:
    """Media of each slide with duplicates, from relationship parts made of the pages' links."""
    found = package.slide_media(_rels(spark, d))
    return found.groupBy("filename").agg(F.array_join(F.sort_array(F.collect_list("slide_no")), ",").alias("slides"))


def _rels(spark: SparkSession, d: str, folder: F.Column | None = None) -> DataFrame:
    """Relationship parts of slides, or of masters and layouts where folder says so."""
    folder = F.lit("ppt/slides/_rels/slide") if folder is None else folder
    target = F.concat(F.when(F.length("target") % 4 == 0, "../other/").otherwise("../Media/"), F.regexp_replace("target", r"[^A-Za-z0-9]", ""), F.lit(".png"))
    one = F.concat(F.lit('<Relationship Id="r" Target="'), target, F.lit('"/>'))
    per = hrefs(spark, d).groupBy("slide_no").agg(F.concat(F.lit('<Relationships xmlns="urn:x">'), F.array_join(F.collect_list(one), ""), F.lit("</Relationships>")).alias("xml"))
    return per.select(F.concat(folder, "slide_no", F.lit(".xml.rels")).alias("path"), "xml")


_MEDIA = """media AS (SELECT slide_no, regexp_replace(target, '[^A-Za-z0-9]', '', 'g') || '.png' AS filename FROM hrefs WHERE length(target) % 4 <> 0)"""


def _media(spark: SparkSession, d: str) -> DataFrame:
    return hrefs(spark, d).where(F.length("target") % 4 != 0).select("slide_no", F.concat(F.regexp_replace("target", r"[^A-Za-z0-9]", ""), F.lit(".png")).alias("filename"))


def master_only_media(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("slide_no") % 10
    parts = _rels(spark, d, F.when(n == 0, "ppt/slideMasters/_rels/slideMaster").when(n == 1, "ppt/slideLayouts/_rels/slideLayout").otherwise("ppt/slides/_rels/slide"))
    masters = package.master_media(parts)
    return patch.master_only(masters, masters.limit(0), package.slide_media(parts))


def src_media_listing(spark: SparkSession, d: str) -> DataFrame:
    m = _media(spark, d)
    listing = patch.media_listing(m, m.where("slide_no % 10 > 3"), m.where("slide_no % 10 = 0").select("filename").distinct())
    return listing.select("filename", F.array_join(F.transform("slides", lambda x: x.cast("string")), ",").alias("slides"), "is_master_only")


def src_asset_listing(spark: SparkSession, d: str) -> DataFrame:
    paths = filenames(spark, d).select(F.col("source").alias("package"), F.concat(F.lit("Data/"), _asset_name()).alias("path"))
    refs = table(spark, d, "conversations").join(filenames(spark, d).select(F.col("source").alias("package"), F.col("doc_id").alias("conv_id")), "conv_id")
    sets = refs.groupBy("package", F.col("conv_id").alias("data_ref")).agg(F.sort_array(F.collect_set("turn")).alias("slides"))
    files = archive.data_files(paths)
    listing = archive.asset_listing(files, archive.named_assets(sets, files))
    return listing.select("package", "filename", "object_id", F.array_join(F.transform("slides", lambda x: x.cast("string")), ",").alias("slides"))


def content_type_missing(spark: SparkSession, d: str) -> DataFrame:
    fn = filenames(spark, d)
    needed = fn.select(F.col("source").alias("package"), S.extension(_asset_name()).alias("ext"))
    own = fn.where("id % 2 = 0 AND length(source) % 2 = 0").groupBy(F.col("source").alias("package")).agg(F.collect_set(F.concat(F.lit('<Default Extension="'), F.upper("ext"), F.lit('"/>'))).alias("types"))
    parts = own.select("package", F.lit("[Content_Types].xml").alias("path"), F.concat(F.lit('<Types xmlns="urn:x">'), F.array_join("types", ""), F.lit("</Types>")).alias("xml"))
    return patch.missing_content_types(needed, package.content_types(parts))


def package_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as parts of 50 packages to the shared folder, and every second one read back by its place."""
    folder = f"{shared.folder(spark)}/packages-{uuid.uuid4().hex}"
    pages = table(spark, d, "pages").select(F.concat((F.col("page_id") % 50).cast("string"), F.lit(".pptx")).alias("package"), "page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("bytes"))
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "ppt/slides/slide").otherwise("ppt/media/"), "page_id", F.lit(".xml"))
    zips.write(pages.select("package", path.alias("path"), "bytes"), folder)
    back = package.entries(spark, f"{folder}/*.pptx", "^ppt/slides/")
    return back.select(S.basename(F.col("package")).alias("package"), "path", F.octet_length("bytes").cast("long").alias("size"), F.md5("bytes").alias("digest"))


def rewrite_refs(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    parts = pages.select((F.col("page_id") % 50).cast("string").alias("package"), F.col("page_id").cast("string").alias("path"), F.col("html").alias("xml"))
    plan = spark.range(0, 100).select((F.col("id") % 25).cast("string").alias("package"), F.col("id").alias("seq"), F.concat(F.lit("p"), (F.col("id") % 2).cast("string"), F.lit(">")).alias("old"),
                                      F.concat(F.lit("q"), F.col("id").cast("string"), F.lit(">")).alias("new"))
    plan = plan.unionAll(plan.select("package", F.col("seq") + 1000, F.lit("<p>"), F.concat(F.lit("<r"), F.col("seq").cast("string"), F.lit(">"))))
    return patch.rewrite(parts, plan).select("path", F.md5("xml").alias("digest"))


def patched_parts(spark: SparkSession, d: str) -> DataFrame:
    """Packages of 20 pages each, patched: media named by links, every third length of a name replaced, in both ways of referring to it."""
    package = (F.col("slide_no") % 20).cast("string").alias("package")
    links = hrefs(spark, d).select(package, "slide_no", "target", F.concat(F.regexp_replace("target", r"[^A-Za-z0-9]", ""), F.lit(".png")).alias("name"))
    way = F.when(F.length("target") % 2 == 0, "../media/").otherwise("/ppt/media/")
    one = F.concat(F.lit('<Relationship Id="r" Target="'), way, "name", F.lit('"/>'))
    rels = links.groupBy("package", "slide_no").agg(F.concat(F.lit('<Relationships xmlns="urn:x">'), F.array_join(F.sort_array(F.collect_list(one)), ""), F.lit("</Relationships>")).alias("xml"))
    parts = rels.select("package", F.concat(F.lit("ppt/slides/_rels/slide"), "slide_no", F.lit(".xml.rels")).alias("path"), "xml")
    types = links.select("package").distinct().select("package", F.lit("[Content_Types].xml").alias("path"), F.lit('<Types xmlns="urn:x"><Default Extension="png" ContentType="image/png"/></Types>').alias("xml"))
    stored = links.select("package", F.concat(F.lit("ppt/media/"), "name").alias("path"), F.col("name").alias("xml")).distinct()
    entries = parts.unionByName(types).unionByName(stored).select("package", "path", F.encode("xml", "UTF-8").alias("bytes"))
    plan = links.where(F.length("name") % 3 == 0).select("package", F.col("name").alias("old_name")).distinct()
    plan = plan.select("package", F.col("old_name").alias("seq"), "old_name", F.concat(S.stem(F.col("old_name")), F.lit("_repl.svg")).alias("new_name"))
    media = plan.select("package", "new_name", F.encode(F.concat(F.lit("drawn "), "new_name"), "UTF-8").alias("bytes"))
    return patch.patched(entries, plan, media).select("package", "path", F.md5("bytes").alias("digest"))


def overflow_inject(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    svg = F.concat(F.when(i % 3 == 0, '<?xml version="1.0"?>').otherwise(""), F.when(i % 5 == 0, "<g>").otherwise("<svg"), F.when(i % 7 == 0, ' overflow="visible"').otherwise(""), F.lit(' id="'), i, F.lit('"><g/></svg>'))
    return table(spark, d, "pages").select("page_id", S.inject_overflow(svg).alias("svg"))


def _graph(spark: SparkSession, d: str):
    t = lambda n: table(spark, d, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    edges = (
        t("nation").select(name("R", "n_regionkey").alias("src"), name("N", "n_nationkey").alias("dst"))
        .union(t("customer").select(name("N", "c_nationkey"), name("C", "c_custkey")))
        .union(t("orders").select(name("C", "o_custkey"), name("O", "o_orderkey")))
        .union(t("customer").select(name("C", "c_custkey"), name("N", "c_nationkey")))
    )
    roots = t("region").select(F.col("r_regionkey").alias("slide_no"), name("R", "r_regionkey").alias("node"))
    blocked = t("nation").where("n_nationkey % 7 = 0").select(name("N", "n_nationkey").alias("node"))
    data = t("lineitem").select(name("O", "l_orderkey").alias("obj"), F.col("l_partkey").alias("data_ref"))
    return roots, edges, blocked, data


_GRAPH = """edges AS (
  SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
), blocked AS (SELECT 'N' || n_nationkey AS node FROM nation WHERE n_nationkey % 7 = 0)
, seen AS (
  SELECT r_regionkey AS slide_no, 'R' || r_regionkey AS node FROM region
  UNION SELECT slide_no, dst FROM seen JOIN edges ON node = src WHERE dst NOT IN (SELECT node FROM blocked)
)"""


def graph_reach(spark: SparkSession, d: str) -> DataFrame:
    roots, edges, blocked, _ = _graph(spark, d)
    return graph.reachable(roots, edges, blocked)


def graph_slide_sets(spark: SparkSession, d: str) -> DataFrame:
    roots, edges, blocked, data = _graph(spark, d)
    sets = graph.slide_assets(graph.reachable(roots, edges, blocked), data)
    return sets.select("data_ref", F.array_join(F.transform("slides", lambda x: x.cast("string")), ",").alias("slides"))


def first_message_type(spark: SparkSession, d: str) -> DataFrame:
    """Archives whose first message is a show: orders with their lines as messages."""
    lines = table(spark, d, "lineitem")
    per = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber"), (F.col("l_partkey") % 3).alias("type")))).alias("messages"))
    return per.where(archive.is_show(F.col("messages"))).select(F.col("l_orderkey").alias("id"))


def session_retention(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("ts").alias("created"))
    return review.retained(s).select("owner", "id")


def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return keyed.first_wins(table(spark, d, "events"), ["user_id"], "event_id").select("user_id", F.col("event_type").alias("kept"))


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return keyed.last_wins(table(spark, d, "events"), ["user_id"], "event_id").select("user_id", F.col("event_type").alias("kept"))


def visible_rect(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    media, crop_w, crop_h = F.col("p_size") * 10, F.col("p_size") * F.pmod("p_partkey", F.lit(11)), F.col("p_size") * F.pmod("p_partkey", F.lit(3))
    same = (crop_w == media) & (crop_h == media)
    return p.select("p_partkey", S.visible_part(crop_w, media, crop_h, same).alias("width"), S.visible_part(crop_h, media, crop_w, same).alias("height"))


def fit_dims(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_size") * 13, F.pmod("p_partkey", F.lit(400)) + 1
    return table(spark, d, "part").select("p_partkey", *[S.fit(side, F.greatest(w, h), 256, up).alias(n) for n, side, up in (("raster_w", w, False), ("raster_h", h, False), ("page_w", w, True), ("page_h", h, True))])


def dpi_formula(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(S.dpi_for_width(F.lit(2560), F.pmod("p_partkey", F.lit(900))), 6).alias("dpi"))


_U = "(['px','pt','mm','cm','in','','em'])[doc_id % 7 + 1]"

QUERIES = {
    "path_parts": (path_parts, """WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages), b AS (SELECT page_id, path, string_split(path, '/')[-1] AS basename FROM p)
SELECT page_id, basename, regexp_replace(basename, '\\.[^./]+$', '') AS stem, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM b"""),
    "strip_id": (strip_id, f"""WITH {FN_SQL}, n AS (SELECT doc_id, stem AS plain, stem || ({list(_ENDINGS)})[doc_id % {len(_ENDINGS)} + 1] AS name FROM fn), p AS (SELECT *, string_split(name, '-') AS parts FROM n)
, l AS (SELECT *, parts[-1] AS tail, length(name) - length(parts[-1]) - 1 AS cut FROM p)
SELECT doc_id, plain, CASE WHEN len(parts) > 1 AND tail SIMILAR TO '[0-9]+' THEN substr(name, 1, cut) ELSE name END AS stripped,
  CASE WHEN len(parts) > 1 AND tail SIMILAR TO '[0-9]*' THEN substr(name, 1, cut) ELSE name END AS dropped FROM l"""),
    "trailing_id": (trailing_id, f"""WITH {FN_SQL}, n AS (SELECT doc_id, filename, string_split(stem || ({list(_ENDINGS)})[doc_id % {len(_ENDINGS)} + 1], '-') AS parts FROM fn)
SELECT doc_id, TRY_CAST(split_part(split_part(filename, '-', 2), '.', 1) AS BIGINT) AS id, CASE WHEN len(parts) > 1 THEN TRY_CAST(CASE WHEN parts[-1] SIMILAR TO '[0-9]+' THEN parts[-1] END AS BIGINT) END AS edge, TRY_CAST(doc_id || '99999999999999999999' AS BIGINT) AS too_long FROM n"""),
    "slide_number": (slide_number, "SELECT page_id, CAST(CASE WHEN page_id % 3 <> 0 THEN page_id END AS INTEGER) AS slide_no FROM pages"),
    "ext_whitelist": (ext_whitelist, f"WITH {FN_SQL}, n AS (SELECT doc_id, {_ASSET} AS name FROM fn) SELECT doc_id, name FROM n WHERE {_IMAGE.format('name')}"),
    "preview_filter": (preview_filter, f"WITH {FN_SQL}, n AS (SELECT doc_id, {_ASSET} AS name FROM fn) SELECT doc_id, name FROM n WHERE NOT {_PREVIEW.format('name')}"),
    "template_flag": (template_flag, "SELECT doc_id, doc_id % 4 = 0 AS is_template FROM documents"),
    "dest_ext": (dest_ext, f"WITH {FN_SQL} SELECT doc_id, CASE WHEN ext = 'png' THEN 'jpg' ELSE ext END AS vector_in_place, CASE WHEN ext = 'png' THEN 'jpg' ELSE 'png' END AS embed_png, CASE WHEN ext = 'png' THEN 'jpg' ELSE 'webp' END AS embed_webp_75 FROM fn"),
    "mime_type": (mime_type, f"""WITH {FN_SQL}, e AS (SELECT doc_id, lower(regexp_extract({_ASSET}, '\\.([^./]+)$', 1)) AS e FROM fn)
SELECT doc_id, CASE e WHEN 'svg' THEN 'image/svg+xml' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime FROM e"""),
    "collision_suffix": (collision_suffix, f"""WITH {FN_SQL}, n AS (SELECT doc_id, stem || '-' || source AS stem, row_number() OVER (PARTITION BY stem || '-' || source ORDER BY doc_id) - 1 AS n FROM fn)
SELECT doc_id, stem || '_repl' || CASE WHEN n = 0 THEN '' ELSE CAST(n AS VARCHAR) END AS new_stem FROM n"""),
    "companion_candidates": (companion_candidates, f"WITH {FN_SQL}, {_COMP} SELECT svg, pdf, gap FROM comp"),
    "companion_pairs": (companion_pairs, f"WITH {FN_SQL}, {_COMP}, {_PAIRS} SELECT svg, pdf, gap FROM prs"),
    "companion_validate": (companion_validate, f"""WITH {FN_SQL}, {_COMP}, {_PAIRS} SELECT svg, pdf, round(delta, 6) AS delta, round(overlap, 6) AS overlap, CAST(x_matches AS INTEGER) AS x_matches, CAST(x_total AS INTEGER) AS x_total,
  round(confidence, 6) AS confidence, confidence >= 0.65::DOUBLE AS is_pair FROM val"""),
    "companion_absorb": (companion_absorb, f"""WITH {FN_SQL}, {_COMP}, {_PAIRS}, f AS (SELECT filename, n_chars AS size, CASE WHEN id % 5 <> 0 THEN id * 31 END AS ahash, id * 17 AS phash, CAST(id % 7 AS DOUBLE) AS moment, n_chars AS width, n_chars % 100 AS height FROM fn WHERE id % 13 <> 0)
SELECT f.filename, f.size, CASE WHEN b.filename IS NOT NULL THEN b.ahash ELSE f.ahash END AS ahash, CASE WHEN b.filename IS NOT NULL THEN b.phash ELSE f.phash END AS phash,
  CASE WHEN b.filename IS NOT NULL THEN b.moment ELSE f.moment END AS moment, CASE WHEN b.filename IS NOT NULL THEN b.width ELSE f.width END AS width,
  CASE WHEN b.filename IS NOT NULL THEN b.height ELSE f.height END AS height, b.filename AS borrowed_from
FROM f LEFT JOIN prs p ON f.filename = p.svg LEFT JOIN f b ON b.filename = p.pdf WHERE f.filename NOT IN (SELECT pdf FROM prs)"""),
    "export_companion": (export_companion, f"WITH {FN_SQL}, p AS (SELECT stem, min(filename) AS pdf FROM fn WHERE ext = 'pdf' GROUP BY stem) SELECT filename AS svg, pdf FROM fn LEFT JOIN p USING (stem) WHERE ext = 'svg'"),
    "pair_jaccard": (pair_jaccard, """WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS w FROM documents)
, p AS (SELECT a.doc_id, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CASE WHEN n > 0 THEN round(CAST(i AS DOUBLE) / (n - i), 6) ELSE 0 END AS jaccard FROM p"""),
    "pair_x_match": (pair_x_match, """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM l)
, t AS (SELECT doc_id, pos, list_filter(string_split(line, ' '), lambda w: w <> '')[1] AS word, (length(line) % 100) / 100.0::DOUBLE AS x FROM e)
, p AS (SELECT doc_id - 1 AS doc_id, word, min(x) AS page_x FROM t WHERE word IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, count(*) AS found, round(count(*) FILTER (WHERE abs(x - page_x) < 0.02::DOUBLE) / count(*), 6) AS ratio FROM t JOIN p USING (doc_id, word) GROUP BY doc_id"""),
    "pair_confidence": (pair_confidence, """WITH c AS (SELECT doc_id, abs((n_chars % 100 - 50) / 10.0::DOUBLE) AS delta, doc_id % 2 = 0 AS t, (doc_id % 11) / 10.0::DOUBLE AS j, (doc_id % 7) / 6.0::DOUBLE AS r FROM documents)
, b AS (SELECT *, CASE WHEN delta < 2 THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, 0.5::DOUBLE - delta / 100) END AS base FROM c)
, v AS (SELECT doc_id, round(least(CASE WHEN t THEN base + 0.35::DOUBLE * j + 0.15::DOUBLE * r WHEN delta < 2 THEN least(base + 0.3::DOUBLE, 0.8::DOUBLE) ELSE base END, 1.0::DOUBLE), 6) AS confidence FROM b)
SELECT doc_id, confidence, confidence >= 0.65::DOUBLE AS is_pair FROM v"""),
    "unit_to_points": (unit_to_points, f"SELECT doc_id, round(n_chars * CASE {_U} WHEN 'pt' THEN 96.0::DOUBLE / 72 WHEN 'mm' THEN 72 / 25.4::DOUBLE WHEN 'cm' THEN 72 / 2.54::DOUBLE WHEN 'in' THEN 72.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS points FROM documents"),
    "dimension_parse": (dimension_parse, f"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0.0::DOUBLE WHEN doc_id % 9 = 1 THEN -(n_chars + 0.5::DOUBLE) ELSE n_chars + 0.5::DOUBLE END AS value,
  CASE WHEN doc_id % 9 = 0 THEN 'auto' || {_U} WHEN {_U} = '' THEN 'px' ELSE {_U} END AS unit FROM documents"""),
    "viewbox_parse": (viewbox_parse, "SELECT doc_id, CAST(CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS DOUBLE) AS width, CAST(CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS DOUBLE) AS height FROM documents"),
    "svg_x": (svg_x, "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id + 0.5::DOUBLE WHEN 1 THEN CAST(-doc_id AS DOUBLE) WHEN 2 THEN CAST(doc_id AS DOUBLE) END AS x FROM documents"),
    "rels_slide_media": (rels_slide_media, f"WITH {HREFS_SQL}, {_MEDIA} SELECT filename, array_to_string(list_sort(list(slide_no)), ',') AS slides FROM media GROUP BY filename"),
    "master_only_media": (master_only_media, f"WITH {HREFS_SQL}, {_MEDIA} SELECT DISTINCT filename FROM media WHERE slide_no % 10 <= 1 AND filename NOT IN (SELECT filename FROM media WHERE slide_no % 10 > 1)"),
    "src_media_listing": (src_media_listing, f"""WITH {HREFS_SQL}, {_MEDIA}, s AS (SELECT filename, list_sort(list(slide_no)) AS slides FROM media WHERE slide_no % 10 > 3 GROUP BY filename)
SELECT filename, coalesce(array_to_string(slides, ','), '') AS slides, false AS is_master_only FROM (SELECT DISTINCT filename FROM media WHERE filename NOT IN (SELECT filename FROM media WHERE slide_no % 10 = 0)) LEFT JOIN s USING (filename)"""),
    "src_asset_listing": (src_asset_listing, f"""WITH {FN_SQL}, n AS (SELECT doc_id, source, {_ASSET} AS name FROM fn), c AS (SELECT conv_id AS doc_id, array_to_string(list_sort(list(DISTINCT turn)), ',') AS slides FROM conversations GROUP BY 1)
SELECT source AS package, name AS filename, regexp_extract(regexp_replace(name, '\\.[^./]+$', ''), '-(\\d+)$', 1) AS object_id, coalesce(slides, '') AS slides FROM n LEFT JOIN c USING (doc_id)
WHERE {_IMAGE.format('name')} AND NOT {_PREVIEW.format('name')}"""),
    "content_type_missing": (content_type_missing, f"""WITH {FN_SQL}, n AS (SELECT DISTINCT source AS package, lower(regexp_extract({_ASSET}, '\\.([^./]+)$', 1)) AS ext FROM fn)
SELECT package, ext FROM n EXCEPT SELECT source, ext FROM fn WHERE id % 2 = 0 AND length(source) % 2 = 0"""),
    "package_round_trip": (package_round_trip, """SELECT page_id % 50 || '.pptx' AS package, 'ppt/slides/slide' || page_id || '.xml' AS path, octet_length(encode(coalesce(html, ''))) AS size, md5(coalesce(html, '')) AS digest
FROM pages WHERE page_id % 2 = 0"""),
    "rewrite_refs": (rewrite_refs, """WITH p AS (SELECT page_id, page_id % 50 AS k, html AS h0 FROM pages)
, a AS (SELECT *, replace(h0, 'p' || (k % 2) || '>', 'q' || k || '>') AS h1 FROM p), b AS (SELECT *, replace(h1, 'p' || ((k + 25) % 2) || '>', 'q' || (k + 25) || '>') AS h2 FROM a)
, c AS (SELECT *, replace(h2, 'p' || ((k + 50) % 2) || '>', 'q' || (k + 50) || '>') AS h3 FROM b), d AS (SELECT *, replace(h3, 'p' || ((k + 75) % 2) || '>', 'q' || (k + 75) || '>') AS h4 FROM c)
SELECT CAST(page_id AS VARCHAR) AS path, md5(CASE WHEN k < 25 THEN replace(h4, '<p>', '<r' || k || '>') ELSE h0 END) AS digest FROM d"""),
    "patched_parts": (patched_parts, f"""WITH {HREFS_SQL}, l AS (SELECT CAST(slide_no % 20 AS VARCHAR) AS package, slide_no, target, regexp_replace(target, '[^A-Za-z0-9]', '', 'g') || '.png' AS name FROM hrefs)
, p AS (SELECT DISTINCT package, name AS old, regexp_replace(name, '\\.png$', '') || '_repl.svg' AS new FROM l WHERE length(name) % 3 = 0)
, w AS (SELECT package, list(way || old || chr(1) || way || new ORDER BY old, way) AS plan FROM p, (SELECT unnest(['../media/', 'ppt/media/']) AS way) GROUP BY package)
, r AS (SELECT package, slide_no, '<Relationships xmlns="urn:x">' || string_agg(one, '' ORDER BY one) || '</Relationships>' AS xml FROM (
    SELECT package, slide_no, '<Relationship Id="r" Target="' || CASE WHEN length(target) % 2 = 0 THEN '../media/' ELSE '/ppt/media/' END || name || '"/>' AS one FROM l) GROUP BY package, slide_no)
SELECT package, 'ppt/slides/_rels/slide' || slide_no || '.xml.rels' AS path, md5(list_reduce(list_prepend(xml, coalesce(plan, [])), lambda a, x: replace(a, split_part(x, chr(1), 1), split_part(x, chr(1), 2)))) AS digest FROM r LEFT JOIN w USING (package)
UNION ALL SELECT DISTINCT package, '[Content_Types].xml', md5('<Types xmlns="urn:x"><Default Extension="png" ContentType="image/png"/>' || CASE WHEN package IN (SELECT package FROM p) THEN '<Default Extension="svg" ContentType="image/svg+xml"/>' ELSE '' END || '</Types>') FROM l
UNION ALL SELECT DISTINCT package, 'ppt/media/' || name, md5(name) FROM l UNION ALL SELECT package, 'ppt/media/' || new, md5('drawn ' || new) FROM p"""),
    "overflow_inject": (overflow_inject, """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<?xml version="1.0"?>' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '<g' || CASE WHEN page_id % 7 = 0 THEN '> overflow="visible"' ELSE '>' END || ' id="' || page_id || '"'
  ELSE '<svg' || CASE WHEN page_id % 7 = 0 THEN ' overflow="visible" id="' || page_id || '"' ELSE ' id="' || page_id || '" overflow="hidden"' END END || '><g/></svg>' AS svg FROM pages"""),
    "graph_reach": (graph_reach, f"WITH RECURSIVE {_GRAPH} SELECT slide_no, node FROM seen"),
    "graph_slide_sets": (graph_slide_sets, f"""WITH RECURSIVE {_GRAPH} SELECT l_partkey AS data_ref, array_to_string(list_sort(list(DISTINCT slide_no)), ',') AS slides FROM seen JOIN lineitem ON node = 'O' || l_orderkey GROUP BY l_partkey"""),
    "first_message_type": (first_message_type, "SELECT l_orderkey AS id FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 3) AS n FROM lineitem) WHERE n = 1 AND l_partkey % 3 = 2"),
    "session_retention": (session_retention, "SELECT user_id AS owner, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts IS NOT NULL) WHERE n > 10"),
    "first_wins": (first_wins, "SELECT user_id, arg_min(event_type, event_id) AS kept FROM events GROUP BY user_id"),
    "last_wins": (last_wins, "SELECT user_id, arg_max(event_type, event_id) AS kept FROM events GROUP BY user_id"),
    "visible_rect": (visible_rect, """WITH p AS (SELECT p_partkey, p_size * 10 AS m, p_size * (p_partkey % 11) AS w, p_size * (p_partkey % 3) AS h FROM part)
SELECT p_partkey, CASE WHEN w > 1 AND h > 1 AND NOT (w = m AND h = m) THEN w ELSE m END AS width, CASE WHEN w > 1 AND h > 1 AND NOT (w = m AND h = m) THEN h ELSE m END AS height FROM p"""),
    "fit_dims": (fit_dims, """WITH p AS (SELECT p_partkey, p_size * 13 AS w, p_partkey % 400 + 1 AS h FROM part), s AS (SELECT *, 256.0::DOUBLE / greatest(w, h) AS s, least(1.0::DOUBLE, 256.0::DOUBLE / greatest(w, h)) AS r FROM p)
SELECT p_partkey, CAST(greatest(1, floor(w * r)) AS INTEGER) AS raster_w, CAST(greatest(1, floor(h * r)) AS INTEGER) AS raster_h, CAST(greatest(1, floor(w * s)) AS INTEGER) AS page_w, CAST(greatest(1, floor(h * s)) AS INTEGER) AS page_h FROM s"""),
    "dpi_formula": (dpi_formula, "SELECT p_partkey, round(2560 / nullif(p_partkey % 900, 0)::DOUBLE * 72, 6) AS dpi FROM part"),
}
