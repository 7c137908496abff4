"""Matching of degraded items with source items: gates, scores, collapse of near duplicates, top three.

Inputs have filename, ahash, phash, moments, width, height, ext. Pairs are found through buckets of the
aspect ratio, an equi-join; items of unknown ratio pass the gate with everything. A bucket is split by
the counts of both its sides into cells of CELL x CELL items at most on average, so that a ratio that most
items share is many tasks. What is broadcast has one row a bucket, of which ratios make a few hundred.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators import keyed, search
from slatewise.shipping import ship
from slatewise.sources import package

CELL = 4096
TOP = 3


def _sides(degraded: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = degraded.select(*[F.col(c).alias(f"d_{c}") for c in degraded.columns]).withColumn("d_bucket", search.ratio_bucket(F.col("d_width"), F.col("d_height")))
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns]).withColumn("s_bucket", search.ratio_bucket(F.col("s_width"), F.col("s_height")))
    return d, s


def _cells(d: DataFrame, s: DataFrame) -> DataFrame:
    """Pairs of d and s with one bucket, cell by cell."""
    size = F.ceil(F.count(F.lit(1)) / CELL).cast("int")
    grid = d.groupBy("bucket").agg(size.alias("d_cells")).join(s.groupBy("bucket").agg(size.alias("s_cells")), "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = d.join(F.broadcast(grid), "bucket").withColumn("d_cell", own("d_filename", "d_cells")).withColumn("s_cell", every("s_cells"))
    right = s.join(F.broadcast(grid), "bucket").withColumn("s_cell", own("s_filename", "s_cells")).withColumn("d_cell", every("d_cells"))
    return left.drop("d_cells", "s_cells").join(right.drop("d_cells", "s_cells"), ["bucket", "d_cell", "s_cell"])


def candidates(degraded: DataFrame, source: DataFrame) -> DataFrame:
    """Pairs that pass the aspect and aHash gates, with their distances and score."""
    d, s = _sides(degraded, source)
    d, s = d.where("d_ahash IS NOT NULL"), s.where("s_ahash IS NOT NULL")
    near = S.hamming(F.col("d_ahash"), F.col("s_ahash")) <= S.AHASH_LIMIT
    gate = S.aspect_gate(F.col("d_width"), F.col("d_height"), F.col("s_width"), F.col("s_height"))
    around = d.where("d_bucket IS NOT NULL").withColumn("bucket", F.explode(F.array(*(F.col("d_bucket") + k for k in (-1, 0, 1)))))
    known = _cells(around, s.where("s_bucket IS NOT NULL").withColumn("bucket", F.col("s_bucket"))).where(near & gate)
    together = F.lit(0).alias("bucket")
    one = _cells(d.where("d_bucket IS NULL").select("*", together), s.select("*", together)).where(near)
    other = _cells(d.where("d_bucket IS NOT NULL").select("*", together), s.where("s_bucket IS NULL").select("*", together)).where(near)
    pairs = known.unionByName(one).unionByName(other)
    return scored(pairs).select("degraded", "source", "source_ext", "s_ahash", "s_phash", "ahash_distance", "phash_distance", "moment_distance", "score")


def scored(pairs: DataFrame) -> DataFrame:
    """Distances of pairs; a null hash is 64 away, null moments infinitely far."""
    moment = F.coalesce(S.moment_distance(F.col("d_moments"), F.col("s_moments")), F.lit(float("inf")).cast("float"))
    phash = F.coalesce(S.hamming(F.col("d_phash"), F.col("s_phash")), F.lit(64))
    out = pairs.select(
        F.col("d_filename").alias("degraded"),
        F.col("s_filename").alias("source"),
        F.col("s_ext").alias("source_ext"),
        "s_ahash",
        "s_phash",
        F.coalesce(S.hamming(F.col("d_ahash"), F.col("s_ahash")), F.lit(64)).alias("ahash_distance"),
        phash.alias("phash_distance"),
        moment.alias("moment_distance"),
    )
    return out.withColumn("score", F.col("phash_distance").cast("float") + F.col("moment_distance") * F.lit(20).cast("float"))


def ranked(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("degraded").orderBy("score", "source")))


def collapsed(pairs: DataFrame, slots: int | None = None) -> DataFrame:
    """degraded, kept: candidates in order of score, near duplicates merged into the first kept one that is near.

    A candidate of a better file kind takes the place of the one it merges into. With ``slots``, only so
    many are held: what happens in the first slots never depends on later ones. Candidates of an item come sorted
    to one task and are folded as they stream by, so that a task holds the kept ones of one item whatever the number of candidates.
    """
    ship(pairs.sparkSession)
    sample = pairs.select("degraded", candidate().alias("c")).select("degraded", "c.*")
    kind = pairs.select(candidate().alias("c")).schema["c"].dataType.simpleString()
    fields = sample.columns[1:]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, kept, done = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[0] != item:
                    if kept:
                        done.append((item, kept))
                    item, kept = row[0], []
                hold(kept, row[1:], slots)
            if done:
                yield _kept(done, fields, batch.schema)
                done = []
            schema = batch.schema
        if kept:
            yield _kept([(item, kept)], fields, schema)

    dealt = sample.where("degraded IS NOT NULL").repartition("degraded").sortWithinPartitions(*sample.columns)
    return dealt.mapInArrow(fold, f"degraded string, kept array<{kind}>")


def hold(kept: list[tuple], new: tuple, slots: int | None) -> None:
    """Takes one more candidate, (score, name, a, p, priority, ...), into those that are kept."""
    a, p, priority = new[2:5]
    for k, (_, _, other_a, other_p, other_priority, *_) in enumerate(kept):
        if _near(a, other_a) or p is not None and p == other_p:
            if priority < other_priority:
                kept[k] = new
            return
    if slots is None or len(kept) < slots:
        kept.append(new)


def _near(a: int | None, b: int | None) -> bool:
    return a is not None and b is not None and ((a ^ b) & _BITS).bit_count() <= S.NEAR_AHASH


_BITS = (1 << 64) - 1


def _kept(done: list[tuple[str, list[tuple]]], fields: list[str], schema: pa.Schema) -> pa.RecordBatch:
    rows = [x for _, kept in done for x in kept]
    ends = [0]
    for _, kept in done:
        ends.append(ends[-1] + len(kept))
    parts = [pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(len(fields))]
    structs = pa.StructArray.from_arrays(parts, fields)
    return pa.RecordBatch.from_arrays([pa.array([item for item, _ in done], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], ["degraded", "kept"])


def candidate() -> Column:
    """A scored pair as a candidate."""
    return F.struct(
        "score",
        F.col("source").alias("name"),
        F.col("s_ahash").alias("a"),
        F.col("s_phash").alias("p"),
        S.extension_priority(F.col("source_ext")).alias("priority"),
        "ahash_distance",
        "phash_distance",
    )


def pinned(degraded: DataFrame, top: DataFrame, structural: DataFrame) -> DataFrame:
    """degraded, is_structural, x, top3, candidates of every degraded item: the structural match in front of two of the top three that differ from it.

    degraded: degraded. structural: degraded, x (a candidate like those of collapsed()); x is null where the
    match has no fingerprint. An item with neither has no candidates.
    """
    joined = degraded.select("degraded").join(top, "degraded", "left").join(structural.select("degraded", "x", F.lit(True).alias("is_structural")), "degraded", "left")
    kept = F.coalesce("kept", F.array().cast(top.schema["kept"].dataType))
    first = F.slice(kept, F.lit(1), F.lit(TOP))
    with_x = F.concat(F.array("x"), F.slice(F.filter(first, lambda c: c["name"] != F.col("x.name")), F.lit(1), F.lit(TOP - 1)))
    return joined.select(
        "degraded", F.coalesce("is_structural", F.lit(False)).alias("is_structural"), "x", first.alias("top3"), F.when(F.col("x").isNull(), first).otherwise(with_x).alias("candidates")
    )


def structural_pairs(membership: DataFrame) -> DataFrame:
    """degraded, source where exactly one source item shares a slide with the degraded one. membership: side, filename, slide_no.

    A slide is its first and its last source; an item's first and last over its slides are the same where there is one. So
    no pairs of a slide are made, and rows stay those of the membership.
    """
    per = membership.where("side = 'source'").groupBy("slide_no").agg(F.min("filename").alias("first"), F.max("filename").alias("last"))
    d = membership.where("side = 'degraded'").select("slide_no", F.col("filename").alias("degraded"))
    found = d.join(per, "slide_no").groupBy("degraded").agg(F.min("first").alias("source"), F.max("last").alias("last"))
    return found.where("source = last").select("degraded", "source")


def upgraded(pairs: DataFrame, source_names: DataFrame) -> DataFrame:
    """Pairs whose PDF partner gives way to the first SVG of the same stripped stem anywhere in the deck. source_names: filename."""
    svg = source_names.where(S.extension(F.col("filename")) == "svg").groupBy(S.strip_id(S.stem(F.col("filename"))).alias("stem")).agg(F.min("filename").alias("svg"))
    own = pairs.withColumn("stem", F.when(S.extension(F.col("source")) == "pdf", S.strip_id(S.stem(F.col("source")))))
    return own.join(svg, "stem", "left").select("degraded", F.coalesce("svg", "source").alias("source"))


def claimed_once(pairs: DataFrame) -> DataFrame:
    """Pairs whose source no other degraded item claims."""
    alone = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("degraded").alias("degraded")).where("n = 1")
    return alone.select("degraded", "source")


def mapping(top: DataFrame) -> DataFrame:
    """The result table: quality and default choice of each degraded item, from pinned().

    The structural match decides the quality and, if near enough, the choice; else the nearest of the top three does.
    """
    first, near = F.try_element_at("candidates", F.lit(1)), F.try_element_at("top3", F.lit(1))
    q = S.quality(first["phash_distance"], F.col("is_structural"))
    choice = S.default_choice(F.col("x.name"), F.col("x.phash_distance"), near["name"], near["phash_distance"])
    return top.select("degraded", "is_structural", "candidates", q.alias("quality"), S.quality_ordinal(q).alias("ordinal"), choice.alias("choice"))


def with_prints(items: DataFrame, prints: DataFrame) -> DataFrame:
    """Items that have a fingerprint, with it and their extension; of items with one name on a side the first by seq, if they have one."""
    if "seq" in items.columns:
        items = keyed.first_wins(items, ["side", "filename"], "seq")
    return items.select("side", "filename").join(prints, ["side", "filename"]).withColumn("ext", S.extension(F.col("filename")))


def matched(items: DataFrame, prints: DataFrame, membership: DataFrame) -> DataFrame:
    """The mapping of every degraded item that has a fingerprint: candidates by distance, the structural match pinned, quality and choice.

    items: side (degraded or source), filename, perhaps seq. prints: side, filename, ahash, phash, moments,
    width, height. membership: side, filename, slide_no.
    """
    known = with_prints(items, prints)
    degraded, source = known.where("side = 'degraded'").drop("side"), known.where("side = 'source'").drop("side")
    structural = claimed_once(upgraded(structural_pairs(membership), items.where("side = 'source'").select("filename").distinct()))
    d, s = _sides(degraded, source)
    both = structural.join(d, structural["degraded"] == d["d_filename"]).join(s, structural["source"] == s["s_filename"])
    x = scored(both.drop("degraded", "source")).select("degraded", candidate().alias("x"))
    top = search.collapsed(degraded, source, TOP)
    return mapping(pinned(degraded.select(F.col("filename").alias("degraded")), top, structural.select("degraded").join(x, "degraded", "left")))


def slide_counts(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """package, degraded_slides, source_slides and whether they differ, for the packages of either deck.

    paths: package, path of the degraded deck's entries: a slide is a relationship part of its own, with media or
    without. roots: package, slide_no of the source deck's shows (archive.slide_roots()): as many slides as the longest show lists.
    A deck that the other table lacks has 0.
    """
    number = F.when(F.col("path").rlike(package.SLIDE_RELS), S.slide_number(F.col("path")))
    own = paths.groupBy("package").agg(F.count_distinct(number).alias("degraded_slides"))
    shown = roots.groupBy("package").agg(F.max("slide_no").cast("bigint").alias("source_slides"))
    both = own.join(shown, "package", "full").fillna(0, ["degraded_slides", "source_slides"])
    return both.withColumn("mismatch", F.col("degraded_slides") != F.col("source_slides"))
