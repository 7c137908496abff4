"""What has to stay small or linear: collapse of many candidates, slides of many items, counts, retention, last archives."""

import random
import tracemalloc

from conftest import SF
from pyspark.sql import functions as F

from slatewise.operators import companion, match, review
from slatewise.plans import archives
from slatewise.sources import archive

PAIRS = "degraded string, source string, source_ext string, s_ahash bigint, s_phash bigint, ahash_distance int, phash_distance int, score float"


def test_collapse_of_one_item_with_many_candidates(spark):
    """300,000 candidates of one item pass through one task, which holds three of them; nulls and bit 63 among them."""
    n = 300_000
    i = F.col("id")
    rows = spark.range(n).select(
        F.lit("d").alias("degraded"), F.format_string("s%07d", i).alias("source"), F.when(i % 7 == 0, "svg").otherwise("png").alias("source_ext"),
        F.when(i % 5 != 0, F.xxhash64(i)).alias("s_ahash"), F.when(i % 3 != 0, F.xxhash64(i % 50)).alias("s_phash"),
        F.lit(1).alias("ahash_distance"), (i % 60).cast("int").alias("phash_distance"), (i % 61).cast("float").alias("score"),
    )
    rows = rows.unionByName(rows.where("source < 's0000040'").withColumn("degraded", F.lit("e")))
    got = {r.degraded: r.names for r in match.collapsed(rows, 3).select("degraded", F.transform("kept", lambda c: c["name"]).alias("names")).collect()}
    priority = {"svg": 0, "png": 2}
    for item in ("d", "e"):
        kept = []
        own = rows.where(F.col("degraded") == item).orderBy("score", "source").select("score", "source", "s_ahash", "s_phash", "source_ext").collect()
        for r in own:
            for k, x in enumerate(kept):
                near = x.s_ahash is not None and r.s_ahash is not None and ((x.s_ahash ^ r.s_ahash) & (2**64 - 1)).bit_count() <= 2
                if near or x.s_phash is not None and x.s_phash == r.s_phash:
                    if priority[r.source_ext] < priority[x.source_ext]:
                        kept[k] = r
                    break
            else:
                if len(kept) < 3:
                    kept.append(r)
        assert got[item] == [x.source for x in kept]


def test_fold_holds_the_slots():
    rng = random.Random(4)
    kept = []
    tracemalloc.start()
    for i in range(200_000):
        match.hold(kept, (float(i), str(i), rng.getrandbits(64), rng.getrandbits(64), i % 4, 0, 0), 3)
    assert len(kept) == 3 and tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


def test_a_slide_of_many_items(spark):
    """100,000 items of either side on one slide: 10^10 pairs, none of which is made."""
    many = spark.range(100_000)
    rows = many.select(F.lit("degraded").alias("side"), F.format_string("d%d", "id").alias("filename"), F.lit(1).alias("slide_no"))
    rows = rows.union(many.select(F.lit("source"), F.format_string("s%d", "id"), F.lit(1)))
    alone = spark.createDataFrame([("degraded", "x", 2), ("source", "only", 2), ("source", "only", 2), ("degraded", "d5", 2), ("degraded", "y", 3), ("degraded", "z", 2), ("source", "z2", 4), ("degraded", "z", 4)], rows.schema)
    got = match.structural_pairs(rows.union(alone)).collect()
    assert [tuple(r) for r in got] == [("x", "only")]


def test_slide_counts(spark):
    """Slides without media count, other parts don't; a deck counts as many slides as its longest show lists."""
    paths = [("p", f"ppt/slides/_rels/slide{i}.xml.rels") for i in (1, 2, 3, 3)] + [("p", "ppt/slides/slide9.xml"), ("p", "ppt/slideLayouts/_rels/slideLayout4.xml.rels"), ("q", "ppt/presentation.xml")]
    roots = [("p", i, 100 + i) for i in range(1, 5)] + [("p", 1, 7), ("r", 1, 1)]
    got = match.slide_counts(spark.createDataFrame(paths, "package string, path string"), spark.createDataFrame(roots, "package string, slide_no int, node bigint"))
    assert sorted(map(tuple, got.collect())) == [("p", 3, 4, True), ("q", 0, 0, False), ("r", 0, 1, True)]


def test_retention_over_all(spark):
    rows = [(i, f"2024-01-{1 + i % 20:02} 00:00:00") for i in range(40)] + [(99, None)]
    s = spark.createDataFrame(rows, "id int, at string").select("id", F.col("at").cast("timestamp").alias("created"))
    newest = sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0]), reverse=True)
    for keep in (10, 3, 40, 100):
        assert sorted(r.id for r in review.retained(s, keep).collect()) == sorted(r[0] for r in newest[keep:])
    assert review.retained(s.limit(0)).count() == 0


def test_retention_of_each_owner(spark):
    rows = [("a", i, f"2024-01-{1 + i % 20:02} 00:00:00") for i in range(30)] + [("b", i, "2024-01-01 00:00:00") for i in range(12)] + [("b", 99, None), ("c", 1, "2023-01-01 00:00:00")]
    s = spark.createDataFrame(rows, "owner string, id int, at string").select("owner", "id", F.col("at").cast("timestamp").alias("created"))
    want = []
    for owner in "abc":
        want += sorted((r for r in rows if r[0] == owner and r[2]), key=lambda r: (r[2], r[1]), reverse=True)[10:]
    got = review.retained(s)
    assert got.columns == s.columns and sorted((r.owner, r.id) for r in got.collect()) == sorted(r[:2] for r in want)


def test_last_archive_of_an_id(spark):
    kind = f"package string, path string, position int, {archive.ARCHIVES}"
    info = [{"type": 1, "length": 1, "object_refs": [], "data_refs": []}]
    rows = [("p", "Index/a.iwa", 0, 1, True, info, b"a0"), ("p", "Index/a.iwa", 2, 1, False, info, b"a2"), ("p", "Index/b.iwa", 0, 1, False, info, b"b0"), ("q", "Index/a.iwa", 0, 1, False, info, b"q0"), ("p", "Index/a.iwa", 1, 2, False, info, b"a1")]
    got = archive.last_of_each(spark.createDataFrame(rows, kind))
    assert got.columns == spark.createDataFrame([], kind).columns
    assert sorted((r.package, r.id, bytes(r.payload), r.is_template) for r in got.collect()) == [("p", 1, b"b0", True), ("p", 2, b"a1", False), ("q", 1, b"q0", False)]


def test_archives_in_one_pass(spark):
    """Archives are made once for both versions of an order, and their two kinds of edges come from one pass."""
    for query, decodes in ((archives.archive_edges, 1), (archives.archive_headers, 1)):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapIn") == decodes and "Union" not in plan


def test_archives_of_any_bytes(spark, monkeypatch):
    """Types and references of 64 bits, several messages, none, a file without bytes; batches that are given in parts."""
    monkeypatch.setattr(archive, "AT_ONCE", 3)
    tall = b"\xff" * 9 + b"\x01"
    info = lambda kind, length, objects, data: b"\x08" + kind + b"\x18" + bytes([length]) + b"\x2a" + bytes([len(objects)]) + objects + b"\x32" + bytes([len(data)]) + data
    def one(identifier, payload, *infos):
        head = b"\x08" + bytes([identifier]) + b"".join(b"\x12" + bytes([len(i)]) + i for i in infos)
        return bytes([len(head)]) + head + payload
    stream = one(1, b"abcde", info(b"\x05", 2, tall + b"\x07", b""), info(tall, 3, b"", b"\x81\x01")) + one(2, b"") + one(3, b"xyz", info(b"\x06", 3, b"\x09", tall))
    file = b"\x00" + len(stream).to_bytes(3, "little") + stream
    rows = [("p", "Index/a.iwa", file), ("p", "Index/b.iwa", None), ("p", "Index/c.iwa", b"\x01abc"), ("p", "Index/d.iwa", file), ("p", "Data/e.iwa", file)]
    found = archive.decoded(spark.createDataFrame(rows, "package string, path string, bytes binary").coalesce(1))
    got = sorted((r.path[6], r.position, r.id, [tuple(m) for m in r.message_infos], bytes(r.payload)) for r in found.collect())
    want = [(0, 1, [(5, 2, [-1, 7], []), (-1, 3, [], [129])], b"abcde"), (1, 2, [], b""), (2, 3, [(6, 3, [9], [-1])], b"xyz")]
    assert got == [(path, *w) for path in "ad" for w in want]
    edges = archive.edges(found.where("path = 'Index/a.iwa'"))
    assert sorted(map(tuple, edges.collect())) == [("p", "data", 1, 129), ("p", "data", 3, -1), ("p", "object", 1, -1), ("p", "object", 1, 7), ("p", "object", 3, 9)]


def test_validator_cases(spark):
    """First words that occur twice, an unreadable page, a drawing without metrics, a place that is missing."""
    found = spark.createDataFrame([("a.svg", "a.pdf", 1), ("a.svg", "b.pdf", 2), ("n.svg", "a.pdf", 1), ("a.svg", "none.pdf", 3)], "svg string, pdf string, gap int")
    texts = "array<struct<x double, content string>>"
    drawings = spark.createDataFrame([("a.svg", 100.0, "px", 50.0, "px", None, None, [(10.0, "one two"), (90.0, "two one"), (5.0, "  three"), (1.0, ""), (None, "one")])],
                                     f"filename string, width double, width_unit string, height double, height_unit string, vb_width double, vb_height double, texts {texts}")
    words = "array<struct<text string, x_min double>>"
    pages = spark.createDataFrame([("a.pdf", 100.0, 50.0, [("one", 11.0), ("two", 50.0), ("one", 90.0), ("", 1.0)]), ("b.pdf", 100.0, 51.0, [("three", None), ("three", 5.0)])], f"filename string, width double, height double, words {words}")
    got = {(r.svg, r.pdf): (r.x_matches, r.x_total, round(r.overlap, 3), r.is_pair) for r in companion.validated(found, drawings, pages).collect()}
    assert got == {("a.svg", "a.pdf"): (1, 2, 0.667, True), ("a.svg", "b.pdf"): (0, 0, 0.333, False), ("n.svg", "a.pdf"): (0, 0, 0.0, False), ("a.svg", "none.pdf"): (0, 0, 0.0, False)}
