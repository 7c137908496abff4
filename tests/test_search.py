"""Candidates found where the item is, against the loop and against the table of pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_models import FP, PRIORITY, model, near_random, signed

from slatewise.operators import match, search
from slatewise.plans import matching

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["top3", "dedup_greedy", "score_rank", "gate_ahash", "xml_pinned"])
def test_no_pair_is_shuffled(spark, name):
    """Pairs grow as the product of both sides; what is dealt out by item or by group is rows of one side."""
    plan = getattr(matching, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "s_cell" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("block", [4096, 3])
def test_search_is_the_loop(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rng = random.Random(block)
    bases = [rng.getrandbits(64) for _ in range(3)]
    rows = []
    for i in range(160):
        h = near_random(rng, rng.choice(bases))
        moments = rng.choice((None, [], [1.0, 2.0], [1.0, 2.0, float(rng.randrange(3))], [0.0, 0.0, 0.0]))
        ext = rng.choice(list(PRIORITY))
        rows.append((f"{i:03}.{ext}", None if rng.random() < 0.1 else signed(h), rng.choice((None, signed(near_random(rng, h)), signed(bases[0]))), moments, rng.choice((None, 0, 100, 108, 300)), rng.choice((100, 90, None)), ext))
    degraded, source = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    want = model(degraded, source)
    d, s = spark.createDataFrame(degraded, FP), spark.createDataFrame(source, FP)
    ranked = search.ranked(d, s).groupBy("degraded").agg(F.sort_array(F.collect_list(F.struct("rank", "source"))).alias("c"))
    assert {r.degraded: [(c.rank, c.source) for c in r.c] for r in ranked.collect()} == {k: list(enumerate(v[0], 1)) for k, v in want.items()}
    pairs = match.candidates(d, s).cache()
    counts = pairs.groupBy("degraded").agg(F.count(F.lit(1)).alias("n"), F.max("ahash_distance").alias("most"))
    assert sorted(search.counted(d, s).collect()) == sorted(counts.collect())
    for slots in (None, 1, 3):
        got = {r.degraded: r.kept for r in search.collapsed(d, s, slots).collect()}
        assert got == {r.degraded: r.kept for r in match.collapsed(pairs, slots).collect()}
        assert {k: [c.name for c in v] for k, v in got.items()} == {k: v[1][:slots] for k, v in want.items()}


def test_sources_are_copied_for_few_groups(spark, monkeypatch):
    """Ten times the items don't copy each source ten times as often: a bucket is cut by its share of the pairs, not by its items alone."""
    monkeypatch.setattr(search, "BLOCK", 4)
    h = F.lit(5).cast("bigint")
    kind = [h.alias("ahash"), h.alias("phash"), F.array(F.lit(1.0)).alias("moments"), F.when(F.col("id") % 5 > 0, 100 + 100 * (F.col("id") % 3)).cast("int").alias("width"), F.lit(100).alias("height"), F.lit("png").alias("ext")]
    s = spark.range(50).select(F.format_string("s%d", "id").alias("filename"), *kind)
    copies = []
    for n in (1000, 10_000):
        rows = search._groups(spark.range(n).select(F.format_string("d%d", "id").alias("filename"), *kind), s)
        of = {r.is_item: r["count"] for r in rows.groupBy("is_item").count().collect()}
        assert of[True] == n
        copies.append(of[False])
        groups = rows.select("bucket", "cell").distinct().count()
        assert rows.select("bucket", "cell", F.spark_partition_id()).distinct().count() == groups  # a group is in one task
    assert copies[1] == copies[0]


def test_numbers_that_are_missing(spark):
    """A missing number among the moments, one name twice, an item that nothing is near to, no source at all."""
    h = 0x0F0F0F0F0F0F0F0F
    d = spark.createDataFrame([("a.png", h, h, [1.0, None], 10, 10, "png"), ("b.png", ~h, h, [1.0], 10, 10, "png"), ("c.png", h, None, [1.0], 10, None, "png")], FP)
    s = spark.createDataFrame([("s.svg", h, h, [1.0, 2.0], 10, 10, "svg"), ("t.pdf", h ^ 7, h, [None], 10, 10, "pdf"), ("t.pdf", h ^ 7, None, [4.0], 10, 10, "pdf"), ("u.png", h ^ 7, 1, [1.0], 90, 10, "png")], FP)
    pairs = match.candidates(d, s)
    for slots in (None, 3):
        got = {r.degraded: r.kept for r in search.collapsed(d, s, slots).collect()}
        assert got == {r.degraded: r.kept for r in match.collapsed(pairs, slots).collect()} and sorted(got) == ["a.png", "c.png"]
    assert search.ranked(d, s.limit(0)).count() == search.ranked(d.limit(0), s).count() == 0


def test_fold_of_numbers():
    """Many near duplicates that take each other's places."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 60)
        rows = [(float(i), f"{i}", near_random(rng, 0) & 0x1FF, rng.choice((None, 0, 1, 2, 3)), rng.randrange(6)) for i in range(n)]
        slots = rng.choice((None, 1, 2, 3, 5))
        kept = []
        for r in rows:
            match.hold(kept, r, slots)
        a, p, has = np.array([r[2] for r in rows], np.uint64), np.array([r[3] or 0 for r in rows], np.uint64), np.array([r[3] is not None for r in rows])
        assert [rows[x] for x in search.folded(a, p, has, np.array([r[4] for r in rows], np.int8), slots)] == kept


def _batch(n, copies):
    """n sources, each fingerprint copies times, as a group gets them."""
    print_of = np.arange(n) // copies
    columns = {
        "filename": pa.array([f"s{(i * 7919) % n:07}.png" for i in range(n)]),
        "ahash": pa.array(np.int64(7) << (6 * (print_of % 8)).astype(np.int64)),
        "phash": pa.array(print_of.astype(np.int64)),
        "moments": pa.array([[float(x), 1.0, 2.0] for x in print_of], pa.list_(pa.float64())),
        "ratio": pa.array(np.full(n, 1.0)),
        "priority": pa.array(np.where(np.arange(n) % copies == copies - 1, 0, 2).astype(np.int32)),
    }
    return pa.RecordBatch.from_pydict(columns)


def test_sources_are_few_bytes():
    """A task's sources grow by their names and some 20 bytes each: what copies of a fingerprint share is held once, and no Arrow batch is."""
    whole = _batch(40_000, 100)
    sources = search.Sources()
    for k in range(0, 40_000, 10_000):
        sources.add(whole.slice(k, 10_000))
    sources.finish()
    held = sum(x.nbytes for x in vars(sources).values() if isinstance(x, np.ndarray))
    assert held < 24 * 40_000 and sources.name.get_total_buffer_size() < 20 * 40_000 and not sources.held
    assert sources.name.take(pa.array(sources.by_name)).to_pylist() == sorted(sources.name.to_pylist())


def test_fold_looks_at_few_sources(monkeypatch):
    """Copies of what can change nothing any more aren't looked at."""
    sources = search.Sources()
    sources.add(_batch(40_000, 100))
    sources.finish()
    looked, passing = [], search.Sources.passing
    monkeypatch.setattr(search.Sources, "passing", lambda self, *a: looked.append(passing(self, *a)) or looked[-1])
    kept, score = sources.kept(0, 0, [0.0, 1.0, 2.0], 1.0, 3)
    assert len(kept) == 3 and sum(len(at) for at, _ in looked) < 20_000
    rows, bits = [], sources.a ^ np.uint64(0)
    for i in range(40_000):
        c = int(sources.of_class[i])
        p = int(sources.p[c])
        s = np.float32(p.bit_count()) + np.float32(abs(i // 100)) * np.float32(20)
        rows.append((float(s), sources.name[i].as_py(), int(bits[c]), p, int(sources.priority[i])))
    want = []
    for r in sorted(rows):
        match.hold(want, r, 3)
    assert [(sources.name[int(i)].as_py(), float(s)) for i, s in zip(kept, score)] == [(r[1], r[0]) for r in want]


def test_fold_where_levels_rise():
    """Kept ones that take each other's places, in chunks of which parts aren't looked at at first: the fold of the loop all the same."""
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(200, 400)
        rows = sorted((near_random(rng, 0) & 0x3FF, rng.choice((-1, 0, 1, 2, 3)), float(rng.randrange(3)), f"{i:03}", rng.choice((0, 1, 2, 2, 3, 5, 5))) for i in range(n))
        batch = pa.RecordBatch.from_pydict({
            "filename": pa.array([r[3] for r in rows]), "ahash": pa.array([r[0] for r in rows], pa.int64()), "phash": pa.array([None if r[1] < 0 else r[1] for r in rows], pa.int64()),
            "moments": pa.array([[r[2]] for r in rows], pa.list_(pa.float64())), "ratio": pa.array([1.0] * n), "priority": pa.array([r[4] for r in rows], pa.int32()),
        })
        sources = search.Sources()
        sources.add(batch)
        sources.finish()
        for slots in (None, 1, 3):
            want = []
            for r in sorted((float(np.float32(64 if r[1] < 0 else (r[1] ^ 1).bit_count()) + np.float32(r[2] * 20)), r[3], r[0], None if r[1] < 0 else r[1], r[4]) for r in rows):
                match.hold(want, r, slots)
            kept, score = sources.kept(0, 1, [0.0], 1.0, slots)
            assert [(sources.name[int(i)].as_py(), float(s)) for i, s in zip(kept, score)] == [(r[1], r[0]) for r in want]


def test_pairs_of_scores_are_the_table(spark):
    """score_candidates deals out rows of one side, and gives the pairs of the join."""
    frame = matching.score_candidates(spark, SF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "s_cell" not in plan and "MapInArrow" in plan
    pairs = match.candidates(*matching.sides(spark, SF)).select("degraded", "source", "ahash_distance", "phash_distance", F.round("moment_distance", 3), F.round("score", 2))
    assert sorted(frame.collect()) == sorted(pairs.collect())
