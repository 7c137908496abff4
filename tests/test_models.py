"""Order-dependent operators against plain loops, on random groups with every kind of null."""

import random

import pytest
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators import graph, match, patch, review

FP = "filename string, ahash bigint, phash bigint, moments array<double>, width int, height int, ext string"
PRIORITY = {"svg": 0, "pdf": 1, "png": 2, "jpg": 3, "gif": 5}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def bits(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def near_random(rng, base):
    x = base
    for _ in range(rng.choice((0, 1, 2, 4, 9))):
        x ^= 1 << rng.randrange(64)
    return x


@pytest.fixture(scope="module")
def prints():
    rng = random.Random(11)
    bases = [rng.getrandbits(64) for _ in range(3)]
    rows = []
    for i in range(90):
        h = near_random(rng, rng.choice(bases))
        p = None if rng.random() < 0.15 else signed(near_random(rng, h))
        moments = rng.choice((None, [], [1.0, 2.0], [1.0, 2.0, float(rng.randrange(3))], [0.0, 0.0, 0.0]))
        rows.append((f"f{i:02}.{rng.choice(list(PRIORITY))}", None if rng.random() < 0.1 else signed(h), p, moments, rng.choice((None, 0, 100, 108, 300)), rng.choice((100, 90, None)), None))
    return [(*r[:6], r[0].split(".")[1]) for r in rows]


def passes(d, s):
    if d[4] and d[5] and s[4] and s[5]:
        r1, r2 = d[4] / d[5], s[4] / s[5]
        return max(r1, r2) / min(r1, r2) <= 1.1
    return True


def model(degraded, source):
    import numpy as np

    out = {}
    for d in degraded:
        found = []
        for s in source:
            if d[1] is None or s[1] is None or not passes(d, s) or bits(d[1], s[1]) > 25:
                continue
            p = 64 if d[2] is None or s[2] is None else bits(d[2], s[2])
            m = float("inf") if d[3] is None or s[3] is None or len(d[3]) != len(s[3]) else float(np.sqrt(sum((a - b) ** 2 for a, b in zip(d[3], s[3]))))
            score = float(np.float32(p) + np.float32(m) * np.float32(20))
            found.append((score, s[0], s[1], s[2], PRIORITY[s[6]]))
        found.sort(key=lambda c: (c[0], c[1]))
        if not found:
            continue
        kept = []
        for c in found:
            for i, k in enumerate(kept):
                if bits(k[2], c[2]) <= 2 or (k[3] is not None and k[3] == c[3]):
                    if c[4] < k[4]:
                        kept[i] = c
                    break
            else:
                kept.append(c)
        out[d[0]] = ([c[1] for c in found], [c[1] for c in kept])
    return out


def test_match_is_the_loop(spark, prints):
    rng = random.Random(1)
    for _ in range(2):
        rng.shuffle(prints)
        degraded, source = [r for r in prints if int(r[0][1:3]) % 3 == 0], [r for r in prints if int(r[0][1:3]) % 3]
        pairs = match.candidates(spark.createDataFrame(degraded, FP), spark.createDataFrame(source, FP)).cache()
        want = model(degraded, source)
        ranked = match.ranked(pairs).groupBy("degraded").agg(F.sort_array(F.collect_list(F.struct("rank", "source"))).alias("c"))
        assert {r.degraded: [c.source for c in r.c] for r in ranked.collect()} == {k: v[0] for k, v in want.items()}
        names = F.transform("kept", lambda c: c["name"]).alias("names")
        assert {r.degraded: r.names for r in match.collapsed(pairs).select("degraded", names).collect()} == {k: v[1] for k, v in want.items()}
        assert {r.degraded: r.names for r in match.collapsed(pairs, 3).select("degraded", names).collect()} == {k: v[1][:3] for k, v in want.items()}


def test_hamming_and_distance(spark):
    rows = [(0, 0, [3.0, 0.0], [0.0, 4.0]), (-1, 0, [1.0], [1.0, 2.0]), (-(2**63), 0, [], []), (None, 1, None, [1.0])]
    df = spark.createDataFrame(rows, "a bigint, b bigint, x array<double>, y array<double>")
    got = [tuple(r) for r in df.select(S.hamming(F.col("a"), F.col("b")), S.moment_distance(F.col("x"), F.col("y"))).collect()]
    assert got == [(0, 5.0), (64, float("inf")), (1, 0.0), (None, float("inf"))]


def test_structural(spark):
    rows = [("degraded", "a", 1), ("source", "s.pdf", 1), ("degraded", "b", 2), ("source", "s.pdf", 2), ("degraded", "c", 3), ("source", "t-1.pdf", 3), ("source", "t-9.svg", 9), ("degraded", "d", 4), ("source", "x", 4), ("source", "y", 4), ("degraded", "e", 5), ("degraded", "c", 3)]
    m = spark.createDataFrame(rows, "side string, filename string, slide_no int")
    raw = match.structural_pairs(m)
    assert sorted(map(tuple, raw.collect())) == [("a", "s.pdf"), ("b", "s.pdf"), ("c", "t-1.pdf")]
    assert sorted(map(tuple, match.claimed_once(raw).collect())) == [("c", "t-1.pdf")]
    names = m.where("side = 'source'").select("filename").distinct()
    assert dict(map(tuple, match.upgraded(raw, names).collect()))["c"] == "t-9.svg"


def test_pinned(spark):
    kind = "array<struct<score: float, name: string, a: bigint, p: bigint, priority: int, ahash_distance: int, phash_distance: int>>"
    c = lambda n, d: (float(d), n, 1, 1, 0, d, d)
    top = spark.createDataFrame([("a", [c("x", 1), c("y", 2), c("z", 3)]), ("b", [c("x", 20)]), ("c", [c("q", 0)])], f"degraded string, kept {kind}")
    top = top.union(spark.createDataFrame([("f", [c("near", 2), c("x", 9)])], top.schema))
    st = spark.createDataFrame([("a", c("y", 2)), ("b", None), ("d", c("w", 20)), ("f", c("far", 30))], f"degraded string, x {kind[6:-1]}")
    degraded = spark.createDataFrame([(n,) for n in "abcdef"], "degraded string")
    whole = match.mapping(match.pinned(degraded, top, st))
    got = {r.degraded: r for r in whole.collect()}
    assert [k.name for k in got["a"].candidates] == ["y", "x", "z"] and got["a"].quality == "xml_exact" and got["a"].choice == "y"
    assert got["b"].is_structural and got["b"].quality == "poor" and got["b"].choice == "skip"
    import json

    debug = json.loads(review.debug_json(whole, spark.createDataFrame([("a", [1, 4])], "degraded string, slides array<bigint>")).where("degraded = 'a'").head().json)
    assert debug["confirmed_match"] == "y" and [k["user_confirmed"] for k in debug["candidates"]] == [True, False, False] and debug["candidates"][0]["combined_score"] == 2.0
    assert debug["slides"] == [1, 4] and debug["candidates"][0]["cm_distance"] == 0.0
    # a far structural match is shown first, but the near candidate is chosen; an item with neither is a row
    assert [k.name for k in got["f"].candidates] == ["far", "near", "x"] and got["f"].quality == "no_match" and got["f"].choice == "near"
    assert got["e"].candidates == [] and got["e"].quality == "no_match" and got["e"].choice == "skip"
    assert got["c"].quality == "exact" and [k.name for k in got["d"].candidates] == ["w"] and got["d"].choice == "skip"


def test_graph_with_cycles(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(90)]
    roots, blocked = [(1, 0), (2, 7), (3, 11)], {5, 11}
    want = set()
    for slide, root in roots:
        todo, seen = [root], set()
        while todo:
            n = todo.pop()
            if n in seen or n in blocked:
                continue
            seen.add(n)
            todo += [b for a, b in edges if a == n]
        want |= {(slide, n) for n in seen}
    got = graph.reachable(spark.createDataFrame(roots, "slide_no int, node int"), spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(b,) for b in blocked], "node int"))
    assert {tuple(r) for r in got.collect()} == want


def test_rewrite_in_plan_order(spark):
    parts = spark.createDataFrame([("p", "a.rels", "x.png y.png"), ("q", "b.rels", "x.png")], "package string, path string, xml string")
    plan = spark.createDataFrame([("p", 2, "x_repl.png", "z.png"), ("p", 1, "x.png", "x_repl.png")], "package string, seq int, old string, new string")
    assert {r.path: r.xml for r in patch.rewrite(parts, plan).collect()} == {"a.rels": "z.png y.png", "b.rels": "x.png"}


def test_plan_order_and_files(spark):
    kind = "array<struct<score: float, name: string, a: bigint, p: bigint, priority: int, ahash_distance: int, phash_distance: int>>"
    c = lambda n: (1.0, n, 1, 1, 0, 1, 1)
    rows = [("x.jpg", [c("s-1.svg")], 3, "s-1.svg", None), ("x.png", [c("r.tiff")], 1, "gone", None), ("y.png", [], 0, "s.svg", None), ("z.gif", [], 2, "own.pdf", "file:/a/own.pdf"), ("w.png", [c("s-1.svg")], 5, "skip", None)]
    mapping = spark.createDataFrame(rows, f"degraded string, candidates {kind}, ordinal int, choice string, custom_url string")
    plan = patch.plan(mapping, "embed_png")
    assert {r.old_name: (r.new_name, r.source_name, r.url) for r in plan.collect()} == {"x.png": ("x_repl.png", "r.tiff", None), "x.jpg": ("x_repl1.png", "s-1.svg", None), "z.gif": ("z_repl.png", "own.pdf", "file:/a/own.pdf")}
    files = spark.createDataFrame([("s-1.svg", b"svg"), ("s-7.pdf", b"pdf"), ("r.tiff", b"tiff"), ("own.pdf", b"own")], "filename string, bytes binary")
    made = lambda p: {r.new_name: (r.bytes and bytes(r.bytes), r.render_from) for r in patch.materialised(p, files).collect()}
    assert made(plan) == {"x_repl.png": (b"tiff", None), "x_repl1.png": (None, "s-7.pdf"), "z_repl.png": (None, "own.pdf")}
    assert made(patch.plan(mapping)) == {"x_repl.png": (b"tiff", None), "x_repl1.svg": (b"svg", None), "z_repl.pdf": (b"own", None)}


def test_matched_is_whole(spark):
    """Items without a fingerprint give no row, those without candidates give one; a source that two items claim pins neither."""
    h = 0x0F0F0F0F0F0F0F0F
    far = ~h
    prints = [("degraded", "a.png", h, h, None, 10, 10), ("degraded", "b.png", far, far, None, 10, 10), ("degraded", "c.png", h, h, None, 10, 10), ("source", "s.svg", h, h, None, 10, 10), ("source", "t.pdf", far, h, None, 10, 10)]
    items = [(p[0], p[1], n) for n, p in enumerate(prints)] + [("degraded", "none.png", 9), ("source", "s.svg", 10)]
    members = [("degraded", "a.png", 1), ("source", "t.pdf", 1), ("degraded", "b.png", 2), ("degraded", "c.png", 3), ("source", "s.svg", 3), ("degraded", "none.png", 4), ("source", "s.svg", 4)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.degraded: r for r in match.matched(
        frame(items, "side string, filename string, seq int"),
        frame(prints, "side string, filename string, ahash bigint, phash bigint, moments array<double>, width int, height int"),
        frame(members, "side string, filename string, slide_no bigint"),
    ).collect()}
    assert sorted(got) == ["a.png", "b.png", "c.png"]
    assert got["a.png"].is_structural and [c.name for c in got["a.png"].candidates] == ["t.pdf", "s.svg"] and got["a.png"].choice == "t.pdf"
    assert not got["c.png"].is_structural and got["c.png"].choice == "s.svg" and got["c.png"].quality == "exact"
    assert [c.name for c in got["b.png"].candidates] == ["t.pdf"] and got["b.png"].choice == "skip"


def test_validator(spark):
    from slatewise.operators import companion

    metrics = "filename string, width double, width_unit string, height double, height_unit string, vb_width double, vb_height double, texts array<struct<x: double, content: string>>"
    drawings = spark.createDataFrame([
        ("same.svg", 72.0, "pt", 36.0, "pt", 100.0, 50.0, [(10.0, "Hello  world"), (50.0, "axis")]),
        ("bare.svg", 96.0, "px", 48.0, "px", None, None, []),
        ("other.svg", 300.0, "px", 48.0, "px", None, None, [(10.0, "Hello")]),
    ], metrics)
    pages = spark.createDataFrame([("p.pdf", 96.0, 48.0, [("Hello", 9.6), ("world", 30.0), ("axis", 90.0)]), ("empty.pdf", 96.0, 48.0, [])], "filename string, width double, height double, words array<struct<text: string, x_min: double>>")
    found = spark.createDataFrame([("same.svg", "p.pdf", 1), ("bare.svg", "empty.pdf", 1), ("other.svg", "p.pdf", 2), ("same.svg", "lost.pdf", 3)], "svg string, pdf string, gap int")
    got = {(r.svg, r.pdf): (round(r.confidence, 4), r.is_pair, r.x_matches, r.x_total) for r in companion.validated(found, drawings, pages).collect()}
    assert got == {("same.svg", "p.pdf"): (0.925, True, 1, 2), ("bare.svg", "empty.pdf"): (0.8, True, 0, 0), ("other.svg", "p.pdf"): (0.1167, False, 0, 1), ("same.svg", "lost.pdf"): (0.0, False, 0, 0)}


def test_absorbed(spark):
    from slatewise.operators import companion

    schema = "filename string, size bigint, ahash bigint, phash bigint, moments array<double>, width int, height int, error string"
    rows = [("a.svg", 1, 10, 11, [1.0], 5, 5, "e"), ("a.pdf", 2, None, 21, None, 7, 8, None), ("b.svg", 3, 30, 31, [3.0], 5, 5, None)]
    chosen = spark.createDataFrame([("a.svg", "a.pdf"), ("b.svg", "lost.pdf")], "svg string, pdf string")
    got = {r.filename: tuple(r)[1:] for r in companion.absorbed(spark.createDataFrame(rows, schema), chosen).collect()}
    assert got == {"a.svg": (1, None, 21, None, 7, 8, "e", "a.pdf"), "b.svg": (3, 30, 31, [3.0], 5, 5, None, None)}


def test_formats(spark):
    rows = [(1, 0), (999, 255), (12_345, -1), (3_449_999, None), (2_500_000_000, 1)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "size bigint, hash bigint").select(S.byte_count(F.col("size")), S.hex_hash(F.col("hash"))).collect()]
    assert got == [("1 byte", "0" * 16), ("999 bytes", "00000000000000ff"), ("12 KB", "f" * 16), ("3.4 MB", None), ("2.50 GB", "0" * 15 + "1")]
