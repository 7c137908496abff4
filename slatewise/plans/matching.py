"""Queries of fingerprints, gates, scores, collapse, structural matches and the review of what they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators import fingerprint, match, patch, review, search
from slatewise.plans.fixtures import DECK_SQL, FP_SQL, MEMBERS_SQL, deck, fingerprints, membership, sides, table

_FLOAT = "CAST({} AS FLOAT)"
_GATE = """(NOT (coalesce(d.width > 0 AND d.height > 0 AND s.width > 0 AND s.height > 0, false))
    OR greatest(d.width / d.height, s.width / s.height) / least(d.width / d.height, s.width / s.height) <= 1.1::DOUBLE)"""
_CAND = f"""cand AS (
  SELECT d.filename AS degraded, s.filename AS source, s.ext AS source_ext, s.ahash AS s_ahash, s.phash AS s_phash,
    CAST(bit_count(xor(d.ahash, s.ahash)) AS INTEGER) AS ahash_distance,
    CAST(coalesce(bit_count(xor(d.phash, s.phash)), 64) AS INTEGER) AS phash_distance,
    CASE WHEN d.moments IS NULL OR s.moments IS NULL THEN CAST('inf' AS FLOAT)
      ELSE CAST(sqrt((d.moments[1] - s.moments[1]) * (d.moments[1] - s.moments[1]) + (d.moments[2] - s.moments[2]) * (d.moments[2] - s.moments[2])
        + (d.moments[3] - s.moments[3]) * (d.moments[3] - s.moments[3])) AS FLOAT) END AS moment_distance
  FROM fp d JOIN fp s ON d.side = 'degraded' AND s.side = 'source' AND bit_count(xor(d.ahash, s.ahash)) <= 25 AND {_GATE}
), sc AS (SELECT *, CAST(phash_distance AS FLOAT) + moment_distance * CAST(20 AS FLOAT) AS score FROM cand)
, rk AS (SELECT *, row_number() OVER (PARTITION BY degraded ORDER BY score, source) AS rank FROM sc)"""
_PRIORITY = "CASE {} WHEN 'svg' THEN 0 WHEN 'pdf' THEN 1 WHEN 'png' THEN 2 WHEN 'jpg' THEN 3 WHEN 'jpeg' THEN 3 WHEN 'tiff' THEN 4 WHEN 'tif' THEN 4 ELSE 5 END"


def _quality_sql(p: str, structural: str) -> str:
    return f"""CASE WHEN {structural} AND {p} = 0 THEN 'exact' WHEN {structural} AND {p} < 16 THEN 'xml_exact' WHEN {p} = 0 THEN 'exact'
  WHEN {p} < 8 THEN 'strong' WHEN {p} < 16 THEN 'review' WHEN {p} <= 25 THEN 'poor' ELSE 'no_match' END"""


def _folded(room: str) -> str:
    near = "coalesce(bit_count(xor(k.a, c.a)) <= 2 OR k.p = c.p, false)"
    return f"""one AS (SELECT degraded, rank, {{'score': score, 'name': source, 'a': s_ahash, 'p': s_phash, 'priority': {_PRIORITY.format('source_ext')},
    'ahash_distance': ahash_distance, 'phash_distance': phash_distance}} AS c FROM rk)
, fold AS (
  SELECT degraded, CAST(1 AS BIGINT) AS n, [c] AS kept FROM one WHERE rank = 1
  UNION ALL
  SELECT f.degraded, f.n + 1, CASE WHEN list_contains(list_transform(f.kept, lambda k: {near.replace('c.', 'o.c.')}), true)
    THEN list_transform(f.kept, lambda k, i: CASE WHEN i = list_position(list_transform(f.kept, lambda k: {near.replace('c.', 'o.c.')}), true)
      AND o.c.priority < k.priority THEN o.c ELSE k END)
    ELSE {room} END
  FROM fold f JOIN one o ON o.degraded = f.degraded AND o.rank = f.n + 1
), kept AS (SELECT degraded, arg_max(kept, n) AS kept FROM fold GROUP BY degraded)"""


_WHOLE = _folded("list_append(f.kept, o.c)")
_THREE = _folded("CASE WHEN len(f.kept) < 3 THEN list_append(f.kept, o.c) ELSE f.kept END")


def _shown(kept: str = "kept") -> F.Column:
    return F.transform(kept, lambda c: F.concat_ws(":", c["name"], c["phash_distance"].cast("string")))


_SHOWN = "list_transform({}, lambda c: c.name || ':' || c.phash_distance)"


def hamming(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints(spark, d).select("filename", S.hamming(F.col("ahash"), F.col("phash")).alias("distance"))


def gate_ahash(spark: SparkSession, d: str) -> DataFrame:
    return search.counted(*sides(spark, d))


def gate_aspect(spark: SparkSession, d: str) -> DataFrame:
    fp = fingerprints(spark, d)
    return fp.select("filename", S.aspect_gate(F.col("width"), F.col("height"), F.lit(300), F.lit(200)).alias("passes"))


def score_candidates(spark: SparkSession, d: str) -> DataFrame:
    return search.scored(*sides(spark, d)).select("degraded", "source", "ahash_distance", "phash_distance", F.round("moment_distance", 3).alias("moment_distance"), F.round("score", 2).alias("score"))


def score_rank(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(*sides(spark, d))


def dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    return search.collapsed(*sides(spark, d)).select("degraded", F.array_join(_shown(), " ").alias("kept"))


def _top(spark: SparkSession, d: str) -> DataFrame:
    return search.collapsed(*sides(spark, d), match.TOP)


def top3(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("degraded", F.array_join(_shown(), " ").alias("kept"))


_X = f"""{{'score': CAST(coalesce(bit_count(xor(d.phash, s.phash)), 64) AS FLOAT) + CASE WHEN d.moments IS NULL OR s.moments IS NULL THEN CAST('inf' AS FLOAT)
      ELSE CAST(sqrt((d.moments[1] - s.moments[1]) * (d.moments[1] - s.moments[1]) + (d.moments[2] - s.moments[2]) * (d.moments[2] - s.moments[2])
        + (d.moments[3] - s.moments[3]) * (d.moments[3] - s.moments[3])) AS FLOAT) END * CAST(20 AS FLOAT),
    'name': s.filename, 'a': s.ahash, 'p': s.phash, 'priority': {_PRIORITY.format('s.ext')}, 'ahash_distance': CAST(coalesce(bit_count(xor(d.ahash, s.ahash)), 64) AS INTEGER),
    'phash_distance': CAST(coalesce(bit_count(xor(d.phash, s.phash)), 64) AS INTEGER)}}"""
# the rules of the result table, one after another: one source on the slides, claimed by no other item, pinned in front of two of the
# top three; the choice is the pinned one below 16, else the first of the top three below 16, else none
_PINNED = f"""raw AS (
  SELECT a.filename AS degraded, min(b.filename) AS source FROM deck a JOIN deck b ON a.side = 'degraded' AND b.side = 'source' AND a.slide_no = b.slide_no
  GROUP BY a.filename HAVING count(DISTINCT b.filename) = 1
), st AS (
  SELECT u.degraded, CASE WHEN s.filename IS NOT NULL THEN {_X} END AS x
  FROM (SELECT min(degraded) AS degraded, source FROM raw GROUP BY source HAVING count(*) = 1) u JOIN prints d ON d.filename = u.degraded LEFT JOIN prints s ON s.filename = u.source
), pin AS (
  SELECT p.filename AS degraded, st.degraded IS NOT NULL AS is_structural, st.x, coalesce(k.kept[1:3], []) AS top3,
    CASE WHEN st.x IS NULL THEN coalesce(k.kept[1:3], []) ELSE list_concat([st.x], coalesce(list_filter(k.kept[1:3], lambda c: c.name <> st.x.name)[1:2], [])) END AS candidates
  FROM prints p LEFT JOIN kept k ON k.degraded = p.filename LEFT JOIN st ON st.degraded = p.filename WHERE p.side = 'degraded'
), map AS (
  SELECT *, {_quality_sql('candidates[1].phash_distance', 'is_structural')} AS quality,
    CASE WHEN x.phash_distance < 16 THEN x.name WHEN top3[1].phash_distance < 16 THEN top3[1].name ELSE 'skip' END AS choice FROM pin
)"""
_ORDINAL = "CAST(list_position(['xml_exact', 'exact', 'strong', 'review', 'poor', 'no_match'], quality) - 1 AS INTEGER)"
_MAP = f"WITH RECURSIVE {FP_SQL}, {DECK_SQL}, {_CAND.replace('FROM fp d JOIN fp s', 'FROM prints d JOIN prints s')}, {_THREE}, {_PINNED}"


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    return match.matched(*deck(spark, d))


def xml_pinned(spark: SparkSession, d: str) -> DataFrame:
    return _mapping(spark, d).select("degraded", "is_structural", F.array_join(_shown("candidates"), " ").alias("candidates"))


def mapping_order(spark: SparkSession, d: str) -> DataFrame:
    m = _mapping(spark, d)
    return m.select("degraded", "quality", "ordinal", "choice").orderBy("ordinal", "degraded")


def quality_class(spark: SparkSession, d: str) -> DataFrame:
    fp = fingerprints(spark, d)
    p = F.pmod("pk", F.lit(70)).cast("int")
    q = S.quality(p, F.pmod("pk", F.lit(2)) == 0)
    return fp.select("filename", q.alias("quality"), S.quality_label(q).alias("label"), S.distance_band(p).alias("band"))


def ext_priority(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints(spark, d).select("filename", S.extension_priority(F.col("ext")).alias("priority"), S.replacement_kind(F.col("ext")).alias("kind"))


def default_choice(spark: SparkSession, d: str) -> DataFrame:
    return _mapping(spark, d).select("degraded", "choice")


def review_filter(spark: SparkSession, d: str) -> DataFrame:
    return review.reviewed(_mapping(spark, d)).select("degraded", "view")


_VIEW = """CASE WHEN coalesce(candidates[1].ahash_distance = 0, false) THEN 'exact' WHEN choice = 'skip' AND len(candidates) > 0 THEN 'needs_review'
  WHEN choice <> 'skip' THEN 'confirmed' ELSE 'other' END"""


def confirm_all(spark: SparkSession, d: str) -> DataFrame:
    return review.confirm_all(_mapping(spark, d), F.lit(True)).select("degraded", "choice")


def _overrides(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    key = F.concat(F.lit("p"), F.col("doc_id"), F.lit(".svg"))
    choice = F.when(F.col("quality") == 1, F.concat(F.lit("p"), F.col("doc_id") + 1, F.lit(".pdf"))).otherwise("skip")
    url = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://files.example/own/"), F.col("doc_id"), F.lit(".svg")))
    return labels.select(key.alias("degraded"), F.col("doc_id").alias("seq"), choice.alias("choice"), url.alias("url"))


def override_choice(spark: SparkSession, d: str) -> DataFrame:
    return review.overridden(_mapping(spark, d), _overrides(spark, d)).select("degraded", "choice", "custom_url")


_OVERRIDDEN = """ov AS (
  SELECT 'p' || doc_id || '.svg' AS degraded, CASE WHEN doc_id % 4 = 0 THEN doc_id || '.svg' WHEN quality = 1 THEN 'p' || (doc_id + 1) || '.pdf' ELSE 'skip' END AS choice,
    CASE WHEN doc_id % 4 = 0 THEN 'https://files.example/own/' || doc_id || '.svg' END AS url FROM labels
), mo AS (SELECT m.* EXCLUDE (choice), coalesce(ov.choice, m.choice) AS choice, ov.url AS custom_url FROM map m LEFT JOIN ov ON m.degraded = ov.degraded)"""


def pending_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.summary(_mapping(spark, d))


def patch_plan(spark: SparkSession, d: str) -> DataFrame:
    return patch.plan(review.overridden(_mapping(spark, d), _overrides(spark, d)), "embed_png").drop("seq")


def materialised_files(spark: SparkSession, d: str) -> DataFrame:
    """What the plan copies from the source deck, and what it would have to draw; some vectors have a PDF of their stem."""
    fp = fingerprints(spark, d)
    names = fp.where("side = 'source'").select("filename").unionByName(fp.where("pk % 4 = 0").select(F.concat(F.lit("p"), "pk", F.lit("-9.pdf")).alias("filename")))
    files = names.select("filename", F.encode(F.concat(F.lit("bytes of "), "filename"), "UTF-8").alias("bytes"))
    plan = patch.plan(review.overridden(_mapping(spark, d), _overrides(spark, d)), "embed_png")
    return patch.materialised(plan, files).select("new_name", F.md5("bytes").alias("digest"), "render_from")


def debug_mapping(spark: SparkSession, d: str) -> DataFrame:
    m = _mapping(spark, d)
    first = review.first_candidate()
    return m.select(F.col("degraded").alias("filename"), "quality", F.col("is_structural").alias("is_xml_exact"), F.col("choice").alias("confirmed_match"),
                    F.size("candidates").alias("n_candidates"), F.coalesce(first["ahash_distance"], F.lit(64)).alias("ahash_distance"),
                    F.when(first["score"] < float("inf"), F.round(first["score"], 2)).alias("combined_score"))


def slide_label(spark: SparkSession, d: str) -> DataFrame:
    per = membership(spark, d).groupBy("filename").agg(F.sort_array(F.collect_set("slide_no")).alias("slides"))
    return per.select("filename", S.slide_label(F.col("slides")).alias("label"))


def structural_raw(spark: SparkSession, d: str) -> DataFrame:
    return match.structural_pairs(membership(spark, d))


def structural_unique(spark: SparkSession, d: str) -> DataFrame:
    return match.claimed_once(match.structural_pairs(membership(spark, d)))


def sibling_upgrade(spark: SparkSession, d: str) -> DataFrame:
    m = membership(spark, d)
    return match.upgraded(match.structural_pairs(m), m.where("side = 'source'").select("filename").distinct())


def slide_count_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Pages as entries of degraded decks, some with links and some not; conversations as shows of source decks, turns as their slides."""
    i = F.col("page_id")
    folder = F.when(i % 6 == 0, "ppt/slideLayouts/_rels/slideLayout").when(i % 6 == 1, "ppt/slides/slide").otherwise("ppt/slides/_rels/slide")
    paths = table(spark, d, "pages").select((i % 40).cast("string").alias("package"), F.concat(folder, i, F.when(i % 6 == 1, ".xml").otherwise(".xml.rels")).alias("path"))
    c = table(spark, d, "conversations")
    roots = c.select((F.col("conv_id") % 50).cast("string").alias("package"), (F.col("turn") + 1).cast("int").alias("slide_no"), F.col("conv_id").alias("node"))
    return match.slide_counts(paths, roots)


_RAW = """raw AS (
  SELECT a.filename AS degraded, min(b.filename) AS source FROM membership a JOIN membership b ON a.side = 'degraded' AND b.side = 'source' AND a.slide_no = b.slide_no
  GROUP BY a.filename HAVING count(DISTINCT b.filename) = 1)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def fp_ahash(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("vec_id", F.lower(F.lpad(F.hex(fingerprint.average_hash(F.col("v"))), 16, "0")).alias("ahash"))


def fp_phash(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("vec_id", F.lower(F.lpad(F.hex(fingerprint.dct_hash(F.col("v"))), 16, "0")).alias("phash"))


def fp_moments(spark: SparkSession, d: str) -> DataFrame:
    m = _grid(spark, d).withColumn("m", fingerprint.moments(F.col("v")))
    return m.select("vec_id", *[F.round(F.element_at("m", i + 1), 6).alias(n) for i, n in enumerate(("mean", "deviation", "skew"))])


def moment_distance(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    nxt = g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return g.join(nxt, "vec_id").select("vec_id", F.round(S.moment_distance(F.col("v"), F.col("w")).cast("double"), 4).alias("distance"))


def background_rule(spark: SparkSession, d: str) -> DataFrame:
    pixels = F.transform("v", lambda x: F.struct(F.least(F.floor(F.abs(x) * 200), F.lit(255)).alias("value"), F.floor(F.abs(x) * 40).alias("alpha")))
    return _grid(spark, d).select("vec_id", fingerprint.background(pixels).alias("background"))


_BASIS = "cos(pi() * (2 * {x} + 1) * {u} / 16)"
_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_DCT = f"""flat AS (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM v)
, b AS (SELECT k.k, i.i, {_BASIS.format(x='(i.i // 8)', u='(k.k // 8)')} * {_BASIS.format(x='(i.i % 8)', u='(k.k % 8)')} AS c FROM range(64) k(k), range(64) i(i))
, dct AS (SELECT vec_id, k, round(sum(x * c), 6) AS y FROM flat JOIN b USING (i) GROUP BY vec_id, k)
, med AS (SELECT vec_id, list_sort(list(y) FILTER (WHERE k > 0))[32] AS m FROM dct GROUP BY vec_id)"""


def _ahash_sql(flag: str, source: str) -> str:
    return f"""SELECT vec_id, lower(lpad(to_hex(CAST(sum(CASE WHEN {flag} THEN CAST(1 AS UBIGINT) << CAST(i AS UBIGINT) ELSE CAST(0 AS UBIGINT) END) AS UBIGINT)), 16, '0')) AS {{}} FROM {source} GROUP BY vec_id"""


_PLAN = f"""{_MAP}, {_OVERRIDDEN}, n AS (
  SELECT degraded, custom_url, CASE WHEN custom_url IS NOT NULL OR list_contains(list_transform(candidates, lambda c: c.name), choice) THEN choice ELSE candidates[1].name END AS choice FROM mo WHERE choice <> 'skip'
), c AS (SELECT degraded, choice, custom_url, regexp_extract(choice, '\\.([^./]+)$', 1) AS e, regexp_extract(degraded, '\\.([^./]+)$', 1) AS de FROM n WHERE choice IS NOT NULL)
, plan AS (SELECT degraded AS old_name, regexp_replace(degraded, '\\.[^./]+$', '') || '_repl.' || CASE WHEN e IN ('svg', 'pdf') THEN 'png' ELSE de END AS new_name, choice AS source_name,
  CASE WHEN e IN ('svg', 'pdf') THEN e ELSE 'raster' END AS kind,
  CASE CASE WHEN e IN ('svg', 'pdf') THEN 'png' ELSE de END WHEN 'svg' THEN 'image/svg+xml' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime, custom_url AS url FROM c)"""

QUERIES = {
    "hamming": (hamming, f"WITH {FP_SQL} SELECT filename, CAST(bit_count(xor(ahash, phash)) AS INTEGER) AS distance FROM fp"),
    "gate_ahash": (gate_ahash, f"WITH {FP_SQL}, {_CAND} SELECT degraded, count(*) AS n, max(ahash_distance) AS most FROM sc GROUP BY degraded"),
    "gate_aspect": (gate_aspect, f"WITH {FP_SQL} SELECT filename, NOT coalesce(width > 0 AND height > 0, false) OR greatest(width / height, 1.5::DOUBLE) / least(width / height, 1.5::DOUBLE) <= 1.1::DOUBLE AS passes FROM fp"),
    "score_candidates": (score_candidates, f"WITH {FP_SQL}, {_CAND} SELECT degraded, source, ahash_distance, phash_distance, round(moment_distance, 3) AS moment_distance, round(score, 2) AS score FROM sc"),
    "score_rank": (score_rank, f"WITH {FP_SQL}, {_CAND} SELECT degraded, source, CAST(rank AS INTEGER) AS rank FROM rk"),
    "ext_priority": (ext_priority, f"WITH {FP_SQL} SELECT filename, {_PRIORITY.format('ext')} AS priority, CASE ext WHEN 'svg' THEN 'svg' WHEN 'pdf' THEN 'pdf' ELSE 'raster' END AS kind FROM fp"),
    "quality_class": (quality_class, f"""WITH {FP_SQL}, q AS (SELECT filename, CAST(pk % 70 AS INTEGER) AS p, {_quality_sql('(pk % 70)', '(pk % 2 = 0)')} AS quality FROM fp)
SELECT filename, quality, CASE quality WHEN 'xml_exact' THEN 'XML exact' WHEN 'no_match' THEN 'No match' ELSE upper(quality[1]) || quality[2:] END AS label,
  CASE WHEN p >= 64 THEN 'hidden' WHEN p = 0 THEN 'exact' WHEN p < 8 THEN 'near' WHEN p < 16 THEN 'close' ELSE 'far' END AS band FROM q"""),
    "dedup_greedy": (dedup_greedy, f"WITH RECURSIVE {FP_SQL}, {_CAND}, {_WHOLE} SELECT degraded, array_to_string({_SHOWN.format('kept')}, ' ') AS kept FROM kept"),
    "top3": (top3, f"WITH RECURSIVE {FP_SQL}, {_CAND}, {_THREE} SELECT degraded, array_to_string({_SHOWN.format('kept')}, ' ') AS kept FROM kept"),
    "xml_pinned": (xml_pinned, f"{_MAP} SELECT degraded, is_structural, array_to_string({_SHOWN.format('candidates')}, ' ') AS candidates FROM pin"),
    "mapping_order": (mapping_order, f"{_MAP} SELECT degraded, quality, {_ORDINAL} AS ordinal, choice FROM map"),
    "default_choice": (default_choice, f"{_MAP} SELECT degraded, choice FROM map"),
    "review_filter": (review_filter, f"{_MAP} SELECT degraded, {_VIEW} AS view FROM map"),
    "confirm_all": (confirm_all, f"{_MAP} SELECT degraded, CASE WHEN choice = 'skip' AND len(candidates) > 0 THEN candidates[1].name ELSE choice END AS choice FROM map"),
    "override_choice": (override_choice, f"{_MAP}, {_OVERRIDDEN} SELECT degraded, choice, custom_url FROM mo"),
    "pending_summary": (pending_summary, f"""{_MAP} SELECT count(*) AS total, count(*) FILTER (WHERE choice <> 'skip') AS confirmed, count(*) FILTER (WHERE choice = 'skip') AS skipped,
  count(*) FILTER (WHERE choice SIMILAR TO '.*\\.(svg|pdf)') AS vectors, count(*) FILTER (WHERE choice <> 'skip' AND NOT choice SIMILAR TO '.*\\.(svg|pdf)') AS rasters, count(*) FILTER (WHERE choice <> 'skip') > 0 AS can_apply FROM map"""),
    "patch_plan": (patch_plan, f"{_PLAN} SELECT * FROM plan"),
    "materialised_files": (materialised_files, f"""{_PLAN}, names AS (SELECT filename FROM fp WHERE side = 'source' UNION ALL SELECT 'p' || pk || '-9.pdf' FROM fp WHERE pk % 4 = 0)
, first AS (SELECT regexp_replace(regexp_replace(filename, '\\.pdf$', ''), '-[0-9]+$', '') AS stem, min(filename) AS pdf FROM names WHERE filename LIKE '%.pdf' GROUP BY 1)
SELECT new_name, CASE WHEN kind = 'raster' AND f.filename IS NOT NULL THEN md5('bytes of ' || source_name) END AS digest,
  CASE WHEN kind <> 'raster' THEN coalesce(CASE WHEN kind = 'svg' THEN pdf END, source_name) END AS render_from
FROM plan LEFT JOIN names f ON f.filename = source_name LEFT JOIN first ON stem = regexp_replace(regexp_replace(source_name, '\\.[^./]+$', ''), '-[0-9]+$', '')"""),
    "debug_mapping": (debug_mapping, f"""{_MAP} SELECT degraded AS filename, quality, is_structural AS is_xml_exact, choice AS confirmed_match, CAST(len(candidates) AS INTEGER) AS n_candidates,
  coalesce(candidates[1].ahash_distance, 64) AS ahash_distance, CASE WHEN candidates[1].score < CAST('inf' AS FLOAT) THEN round(candidates[1].score, 2) END AS combined_score FROM map"""),
    "slide_label": (slide_label, f"""WITH {MEMBERS_SQL}, s AS (SELECT filename, list_sort(list(DISTINCT slide_no)) AS slides FROM membership GROUP BY filename)
SELECT filename, CASE WHEN len(slides) = 1 THEN 'Slide ' ELSE 'Slides ' END || array_to_string(slides, ', ') AS label FROM s"""),
    "structural_raw": (structural_raw, f"WITH {MEMBERS_SQL}, {_RAW} SELECT degraded, source FROM raw"),
    "structural_unique": (structural_unique, f"WITH {MEMBERS_SQL}, {_RAW} SELECT min(degraded) AS degraded, source FROM raw GROUP BY source HAVING count(*) = 1"),
    "sibling_upgrade": (sibling_upgrade, f"""WITH {MEMBERS_SQL}, {_RAW}, svg AS (SELECT regexp_replace(filename, '-\\d+\\.svg$', '') AS stem, min(filename) AS svg FROM membership WHERE side = 'source' AND filename LIKE '%.svg' GROUP BY 1)
SELECT degraded, coalesce(CASE WHEN source LIKE '%.pdf' THEN svg END, source) AS source FROM raw LEFT JOIN svg ON regexp_replace(source, '-\\d+\\.pdf$', '') = svg.stem"""),
    "slide_count_mismatch": (slide_count_mismatch, """WITH d AS (SELECT CAST(page_id % 40 AS VARCHAR) AS package, count(*) FILTER (WHERE page_id % 6 > 1) AS degraded_slides FROM pages GROUP BY 1)
, s AS (SELECT CAST(conv_id % 50 AS VARCHAR) AS package, CAST(max(turn) + 1 AS BIGINT) AS source_slides FROM conversations GROUP BY 1)
SELECT package, coalesce(degraded_slides, 0) AS degraded_slides, coalesce(source_slides, 0) AS source_slides, coalesce(degraded_slides, 0) <> coalesce(source_slides, 0) AS mismatch FROM d FULL JOIN s USING (package)"""),
    "fp_ahash": (fp_ahash, f"WITH {_V}, e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x, list_sum(v) / 64 AS m FROM v) " + _ahash_sql("x > m", "e").format("ahash")),
    "fp_phash": (fp_phash, f"WITH {_V}, {_DCT}, e AS (SELECT vec_id, k AS i, y, m FROM dct JOIN med USING (vec_id)) " + _ahash_sql("y > m", "e").format("phash")),
    "fp_moments": (fp_moments, f"""WITH {_V}, m AS (SELECT vec_id, v, list_sum(v) / 64 AS m FROM v)
SELECT vec_id, round(m, 6) AS mean, round(sqrt(list_sum(list_transform(v, lambda x: (x - m) ** 2)) / 64), 6) AS deviation,
  round(cbrt(list_sum(list_transform(v, lambda x: (x - m) ** 3)) / 64), 6) AS skew FROM m"""),
    "moment_distance": (moment_distance, f"WITH {_V} SELECT a.vec_id, round(CAST(CAST(list_distance(a.v, b.v) AS FLOAT) AS DOUBLE), 4) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1"),
    "background_rule": (background_rule, f"""WITH {_V}, p AS (SELECT vec_id, list_transform(list_filter(v, lambda x: floor(abs(x) * 40) > 10), lambda x: least(floor(abs(x) * 200), 255)) AS o FROM v)
SELECT vec_id, CASE WHEN len(list_filter(o, lambda x: x < 240)) > 0 THEN 'white' WHEN len(o) > 0 THEN 'black' ELSE 'white' END AS background FROM p"""),
}
