"""Candidates of each degraded item, found, put in order and folded where the item is, so that no pair is shuffled.

Items are dealt into groups by the bucket of their aspect ratio. A group gets the sources that the aspect gate may let
through: those of its bucket and the two beside it, those of unknown ratio, and all of them for items of unknown ratio. They
come sorted to one task, sources first and by fingerprint, and are held as numbers, some 40 bytes a source and as many more for each
fingerprint; items stream by, one at a time, so that a group may have any number of them. Hashes are compared and scores made once for
all sources that share them, and what a fold keeps depends on hashes alone where it is full, so that it looks at few sources. A bucket is cut into groups of BLOCK items, a quarter of that where the ratio is
unknown, but into no more than its share of GROUPS by the pairs it meets: sources are copied once for a group, and rows
shuffled grow as the sources do, never as the pairs.

Names of degraded items are taken to be unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.shipping import ship

BLOCK = 512
GROUPS = 48
UNKNOWN = -(1 << 31)
ROWS = 20_000
WIDE = 8
#: Classes of a group whose near duplicates are listed, and how many of those lists' numbers are held.
LISTED, HELD = 1 << 16, 4_000_000
KEPT = "array<struct<score: float, name: string, a: bigint, p: bigint, priority: int, ahash_distance: int, phash_distance: int>>"
_KINDS = [pa.float32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
_FIELDS = ["score", "name", "a", "p", "priority", "ahash_distance", "phash_distance"]


def ratio_bucket(w: Column, h: Column) -> Column:
    """A bucket ln(ASPECT_LIMIT) wide, null where the ratio is unknown: ratios within the limit are in the same or neighbouring ones."""
    return F.when((w > 0) & (h > 0), F.floor(F.log(w / h) / math.log(S.ASPECT_LIMIT + 1e-9)).cast("int"))


def _grid(d: DataFrame, s: DataFrame) -> DataFrame:
    """bucket, cells, first: the groups of a bucket and the number of its first; those with the most pairs come first. One row a bucket, a few hundred.

    GROUPS is for 12 cores; where there are more, it is four for each.
    """
    groups = max(GROUPS, 4 * d.sparkSession.sparkContext.defaultParallelism)
    items, sources = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), s.groupBy("own").agg(F.count(F.lit(1)).alias("m"))
    meets = F.col("own").isNull() | (F.col("bucket") == UNKNOWN) | F.col("own").between(F.col("bucket") - 1, F.col("bucket") + 1)
    met = items.join(F.broadcast(sources), meets).groupBy("bucket", "n").agg((F.col("n") * F.sum("m").cast("double")).alias("pairs"))
    block = F.when(F.col("bucket") == UNKNOWN, max(BLOCK // 4, 1)).otherwise(BLOCK)  # items of unknown ratio meet all sources
    share = F.ceil(groups * F.col("pairs") / F.sum("pairs").over(Window.partitionBy()))
    cut = met.withColumn("cells", F.least(F.ceil(F.col("n") / block), share).cast("int"))
    before = Window.orderBy(F.desc(F.col("pairs") / F.col("cells")), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select("bucket", "cells", F.coalesce(F.sum("cells").over(before), F.lit(0)).cast("int").alias("first"))


def _groups(degraded: DataFrame, source: DataFrame) -> DataFrame:
    """bucket, cell, is_item and what is compared, a group after another: its sources by name, then its items."""
    own = ratio_bucket(F.col("width"), F.col("height"))
    ratio = F.when(own.isNotNull(), F.col("width") / F.col("height"))
    compared = ["filename", "ahash", "phash", "moments", ratio.alias("ratio"), S.extension_priority(F.col("ext")).alias("priority")]
    d = degraded.where("ahash IS NOT NULL").select(F.coalesce(own, F.lit(UNKNOWN)).alias("bucket"), F.lit(True).alias("is_item"), *compared)
    s = source.where("ahash IS NOT NULL").select(own.alias("own"), F.lit(False).alias("is_item"), *compared)
    grid = F.broadcast(_grid(d, s))
    items = d.join(grid, "bucket").withColumn("cell", F.pmod(F.xxhash64("filename"), F.col("cells")).cast("int"))
    around = F.explode(F.array(*(F.col("own") + k for k in (-1, 0, 1)), F.lit(UNKNOWN)))
    copied = s.where("own IS NOT NULL").withColumn("bucket", around).join(grid, "bucket").unionByName(s.where("own IS NULL").crossJoin(grid))
    sources = copied.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rows = items.drop("cells").unionByName(sources.drop("own", "cells"))
    parts = int(degraded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionById(parts, F.pmod(F.col("first") + F.col("cell"), F.lit(parts))).drop("first")
    return dealt.sortWithinPartitions("bucket", "cell", "is_item", "ahash", "phash", "moments", "filename", "priority")


class Sources:
    """The sources of a group, those of one fingerprint one after another.

    A hash is an aHash; its classes are the pHashes that come with it, theirs are the prints (moments), and those are runs of
    sources. A place is a source's number by name, from where by_name leads to it. Arrow batches are copied to numbers as they come.
    """

    def __init__(self) -> None:
        self.held: dict[str, list] = {c: [] for c in ("name", "ratio", "priority", "a", "p", "has_p", "length", "flat", "size")}
        self.near_to: tuple | None = None
        self.lists: dict[int, np.ndarray] = {}
        self.listed = 0
        self.columns: list[np.ndarray] = []
        self.whole = False

    def add(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        a = batch.column("ahash").to_numpy(zero_copy_only=False).view(np.uint64)
        has_p = batch.column("phash").is_valid().to_numpy(zero_copy_only=False)
        p = batch.column("phash").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        moments = batch.column("moments")
        length = pc.list_value_length(moments).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        start, flat = np.cumsum(length) - length, moments.flatten()
        known = moments.is_valid().to_numpy(zero_copy_only=False)
        if flat.null_count:  # a missing number leaves the distance unknown, as missing moments do
            known[np.repeat(np.arange(n), length)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
            flat = flat.fill_null(0.0)
        flat, known_length = flat.to_numpy(zero_copy_only=False), np.where(known, length, -1)
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (has_p[1:] != has_p[:-1]) | (p[1:] != p[:-1]) | (known_length[1:] != known_length[:-1]) | (known_length[1:] > WIDE)
        for k in range(min(int(length.max(initial=0)), WIDE)):
            both = 1 + np.flatnonzero(~new[1:] & (known_length[1:] > k))
            new[both] = flat[start[both] + k] != flat[start[both - 1] + k]
        first = np.flatnonzero(new)
        print_length = known_length[first]
        at, _ = spread(np.append(start[first], 0), np.arange(len(first)), np.maximum(print_length, 0))
        of = {"a": a[first], "p": p[first], "has_p": has_p[first], "length": print_length, "flat": flat[at], "size": np.diff(np.append(first, n))}
        of |= {"ratio": batch.column("ratio").fill_null(float("nan")).to_numpy(zero_copy_only=False), "priority": batch.column("priority").to_numpy(zero_copy_only=False).astype(np.int8)}
        for c, values in of.items():
            self.held[c].append(np.array(values))
        self.held["name"].append(pa.concat_arrays([batch.column("filename").slice(0, 1), batch.column("filename").slice(1)]))  # a copy: a slice would hold its batch

    def finish(self) -> Sources:
        """Puts together what add() got."""
        if self.whole:
            return self
        joined = lambda c: np.concatenate(self.held.pop(c))
        self.name = pa.concat_arrays(self.held.pop("name"))
        self.by_name = pc.sort_indices(self.name, null_placement="at_start").to_numpy().astype(np.int32)
        self.place = np.empty(len(self.by_name), np.int32)
        self.place[self.by_name] = np.arange(len(self.by_name), dtype=np.int32)
        self.ratio, self.priority = joined("ratio"), joined("priority")
        self.begin = np.concatenate(([0], np.cumsum(joined("size"))))
        self.length, self.moments = joined("length"), joined("flat")
        self.start = np.cumsum(np.maximum(self.length, 0)) - np.maximum(self.length, 0)
        a, p, has_p = joined("a"), joined("p"), joined("has_p")
        other = a[1:] != a[:-1]
        self.prints = np.concatenate(([0], 1 + np.flatnonzero(other | (p[1:] != p[:-1]) | (has_p[1:] != has_p[:-1])), [len(a)]))
        self.a, self.p, self.has_p = (x[self.prints[:-1]] for x in (a, p, has_p))
        self.classes = np.concatenate(([0], 1 + np.flatnonzero(self.a[1:] != self.a[:-1]), [len(self.a)]))
        self.hashes = self.a[self.classes[:-1]]
        self.of_own = self.begin[self.prints]
        self.of_class = np.repeat(np.arange(len(self.a), dtype=np.int32), np.diff(self.of_own))
        self.best = np.minimum.reduceat(self.priority, self.begin[:-1])
        self.whole = True
        return self

    def near(self, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes that pass the aHash gate, their aHash distances, their prints, and which of the classes each print is of. The last answer is held."""
        if self.near_to is None or self.near_to[0] != a:
            distance = np.bitwise_count(self.hashes ^ np.uint64(a & _BITS))
            hashes = np.flatnonzero(distance <= S.AHASH_LIMIT)
            classes, own = spread(self.classes, hashes)
            self.near_to = a, (classes, distance[hashes][own].astype(np.int32), *spread(self.prints, classes))
        return self.near_to[1]

    def phashes(self, classes: np.ndarray, p: int | None) -> np.ndarray:
        """pHash distances of classes."""
        if p is None:
            return np.full(len(classes), 64, np.int32)
        return np.where(self.has_p[classes], np.bitwise_count(self.p[classes] ^ np.uint64(p & _BITS)).astype(np.int32), np.int32(64))

    def passing(self, begin: np.ndarray, of: np.ndarray, ratio: float | None) -> tuple[np.ndarray, np.ndarray]:
        """The sources of prints or classes that pass the aspect gate, and which of those each is of. begin: where theirs begin."""
        at, own = spread(begin, of)
        if ratio is not None:
            r = self.ratio[at]
            passes = ~(np.maximum(r, ratio) / np.minimum(r, ratio) > S.ASPECT_LIMIT)  # an unknown one passes
            at, own = at[passes], own[passes]
        return at, own

    def by_number(self, n: int) -> list[np.ndarray]:
        """The moments of prints that have n, a column each; infinite for the others, so that the distance is too. Those of the last n are held."""
        if len(self.columns) != n:
            same = np.flatnonzero(self.length == n)
            self.columns = [np.full(len(self.length), np.inf) for _ in range(n)]
            for k, column in enumerate(self.columns):
                column[same] = self.moments[self.start[same] + k]
        return self.columns

    def scores(self, at: np.ndarray, phash: np.ndarray, moments: list[float] | None) -> tuple[np.ndarray, np.ndarray]:
        """Moment distances and scores of prints whose pHash distances are given."""
        distance = np.full(len(at), np.inf, np.float32)
        if moments is not None and 0 < len(moments) <= WIDE and None not in moments and all(map(math.isfinite, moments)):
            total = np.zeros(len(at))
            for x, column in zip(moments, self.by_number(len(moments))):
                apart = x - column[at]
                total += apart * apart
            distance = np.sqrt(total).astype(np.float32)
        elif moments is not None and None not in moments:
            same = self.length[at] == len(moments)
            start, total = self.start[at[same]], np.zeros(int(same.sum()))
            for k, x in enumerate(moments):
                apart = x - self.moments[start + k]
                total += apart * apart
            distance[same] = np.sqrt(total).astype(np.float32)
        return distance, phash.astype(np.float32) + distance * np.float32(20)

    def named(self, keys: np.ndarray) -> np.ndarray:
        """The sources whose places are the lower halves of the keys."""
        return self.by_name[keys & np.uint64(0xFFFFFFFF)]

    def close(self, x: int, among: np.ndarray) -> np.ndarray:
        """Classes that are near duplicates of class x: all of them, or those of a list where there are very many classes."""
        if len(self.a) > LISTED:
            return among[np.flatnonzero(_close(self.a[among], self.p[among], self.has_p[among], self.a[x], self.p[x], self.has_p[x]))]
        found = self.lists.get(x)
        if found is None:
            found = np.flatnonzero(_close(self.a, self.p, self.has_p, self.a[x], self.p[x], self.has_p[x]))
            if self.listed + len(found) <= HELD:
                self.listed += len(found)
                self.lists[x] = found
        return found

    def kept(self, a: int, p: int | None, moments: list[float] | None, ratio: float | None, slots: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Sources and scores of what match.hold() keeps of an item's candidates.

        Prints come by score, some at a time, and only sources of prints that can still change something are looked at: those of a
        better kind than what their class has to beat. Where a class has more to beat again, the rest of those prints are looked at anew.
        """
        classes, _, prints, of = self.near(a)
        _, score = self.scores(prints, self.phashes(classes, p)[of], moments)
        bits, order = in_order(score)
        fold = Fold(len(self.a), slots, lambda x: self.close(x, classes))
        kept: list[tuple] = []
        at, step = 0, 64
        while at < len(order) and fold.level[classes].max() > 0:
            end = int(np.searchsorted(bits, bits[min(at + step, len(order)) - 1], "right"))
            part, cls, after = prints[order[at:end]], classes[of[order[at:end]]], None
            best = self.best[part]
            opened = best < fold.level[cls]
            while np.count_nonzero(opened):
                source, own = self.passing(self.begin, part[opened], ratio)
                keys = bits[at:end][opened][own] << np.uint64(32) | self.place[source].astype(np.uint64)
                keys.sort()
                if after is not None:
                    keys = keys[np.searchsorted(keys, after, "right") :]
                source = self.named(keys)
                priority, own = self.priority[source], self.of_class[source]
                x, again = -1, False
                while not again and (x := _next(priority, fold.level, own, x + 1)) >= 0:
                    k, rises = fold.take(int(own[x]), int(priority[x]))
                    kept[k : k + 1] = [(source[x], keys[x])]
                    again = rises and np.count_nonzero((best < fold.level[cls]) > opened) > 0
                if not again:
                    break
                after, opened = keys[x], best < fold.level[cls]
            at, step = end, step * 4
        source, keys = zip(*kept) if kept else ((), ())
        return np.array(source, np.int64), (np.array(keys, np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.float32)


_BITS = (1 << 64) - 1


def spread(begin: np.ndarray, at: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What the ranges of those numbers hold, and which of the ranges each is of. A range ends where the next begins, if n doesn't say how long it is."""
    first = begin[at]
    n = begin[at + 1] - first if n is None else n
    own = np.repeat(np.arange(len(at)), n)
    return np.arange(len(own)) + (first - (np.cumsum(n) - n))[own], own


def in_order(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as numbers, ascending, and their places. A score is no less than 0, so that its bits are in its order."""
    keys = score.view(np.uint32).astype(np.uint64) << np.uint64(32) | np.arange(len(score), dtype=np.uint64)
    keys.sort()
    return keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _close(a: np.ndarray, p: np.ndarray, has_p: np.ndarray, its_a, its_p, its_has_p) -> np.ndarray:
    found = np.bitwise_count(a ^ its_a) <= S.NEAR_AHASH
    return found | (has_p & (p == its_p)) if its_has_p else found


_ROOM, _FULL, _NONE = 127, -1, np.uint32(0xFFFFFFFF)


class Fold:
    """What match.hold() does one by one, for classes of candidates with equal hashes.

    A candidate changes something if its first near kept one is of a worse kind, or if it has none and there is room. Each class
    has the level that its candidates have to beat and its first near kept one.
    """

    def __init__(self, n: int, slots: int | None, close: Callable[[int], np.ndarray]) -> None:
        """n: how many classes there are. close: the near duplicates of a class, itself included."""
        self.slots, self.close = slots, close
        self.first = np.full(n, _NONE, np.uint32)
        self.level = np.full(n, _ROOM, np.int8)
        self.kept: list[tuple[int, int]] = []
        self.room = _ROOM

    def take(self, x: int, priority: int) -> tuple[int, bool]:
        """Takes a candidate of class x that changes something: which of the kept ones it is now, and whether a class may have more to beat than before."""
        first, level, close, k, rises = self.first, self.level, self.close(x), int(self.first[x]), False
        if k == _NONE:
            k = len(self.kept)
            self.kept.append((x, priority))
            taken = close[first[close] == _NONE]
            if self.slots is not None and len(self.kept) == self.slots:
                self.room = _FULL
                level[first == _NONE] = _FULL
        else:
            old, _ = self.kept[k]
            self.kept[k] = x, priority
            held = self.close(old)
            held = held[first[held] == k]
            level[held], first[held] = self.room, _NONE  # the near ones among them are taken below
            taken = close[first[close] >= k]  # those without one as well
            first[taken] = k
            lost = held[first[held] == _NONE]
            if len(lost):
                rises = True
                for j in range(k + 1, len(self.kept)):
                    other, its = self.kept[j]
                    found = np.zeros(len(first), bool)
                    found[self.close(other)] = True
                    found = found[lost]
                    first[lost[found]], level[lost[found]] = j, its
                    lost = lost[~found]
                    if not len(lost):
                        break
            rises = rises or bool((level[taken] < priority).any())
        first[taken], level[taken] = k, priority
        return k, rises


def folded(a: np.ndarray, p: np.ndarray, has_p: np.ndarray, priority: np.ndarray, slots: int | None) -> list[int]:
    """Places of the kept ones among candidates in order: what match.hold() does one by one."""
    fold = Fold(len(a), slots, lambda x: np.flatnonzero(_close(a, p, has_p, a[x], p[x], has_p[x])))
    own, kept, x = np.arange(len(a)), [], -1
    while (x := _next(priority, fold.level, own, x + 1)) >= 0:
        k, _ = fold.take(x, int(priority[x]))
        kept[k : k + 1] = [x]
    return kept


def _next(priority: np.ndarray, level: np.ndarray, own: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that changes something, -1 without one; looked for by growing steps. own: the class of each."""
    step = 64
    while at < len(priority):
        due = priority[at : at + step] < level[own[at : at + step]]
        x = int(due.argmax())
        if due[x]:
            return at + x
        at, step = at + step, step * 4
    return -1


def _each(degraded: DataFrame, source: DataFrame, schema: str, give: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What give() makes of (item, sources) of all items; item: filename, ahash, phash, moments, ratio."""
    ship(degraded.sparkSession)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group, sources = None, Sources()
        for batch in batches:
            keys = np.array([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "cell", "is_item")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                part, (*here, is_item) = batch.slice(begin, end - begin), keys[:, begin].tolist()
                if here != group:
                    group, sources = here, Sources()
                if not is_item:
                    sources.add(part)
                elif sources.whole or sources.held["name"]:
                    sources.finish()
                    for item in zip(*(part.column(c).to_pylist() for c in ("filename", "ahash", "phash", "moments", "ratio"))):
                        yield item, sources

    return _groups(degraded, source).mapInArrow(lambda batches: give(items(batches)), schema)


def counted(degraded: DataFrame, source: DataFrame) -> DataFrame:
    """degraded, n, most: how many candidates an item has, and the greatest aHash distance of them."""

    def give(items: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for (name, a, _, _, ratio), sources in items:
            classes, distance, *_ = sources.near(a)
            _, own = sources.passing(sources.of_own, classes, ratio)
            if len(own):
                done.append((name, len(own), int(distance[own].max())))
            if len(done) >= ROWS:
                yield _rows(done)
                done = []
        if done:
            yield _rows(done)

    return _each(degraded, source, "degraded string, n bigint, most int", give)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    names, n, most = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(most, pa.int32())], ["degraded", "n", "most"])


def ranked(degraded: DataFrame, source: DataFrame) -> DataFrame:
    """degraded, source, rank of all candidates, by score and then name."""

    def give(items: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for (name, a, p, moments, ratio), sources in items:
            classes, _, prints, of = sources.near(a)
            _, score = sources.scores(prints, sources.phashes(classes, p)[of], moments)
            at, own = sources.passing(sources.begin, prints, ratio)
            keys = score.view(np.uint32)[own].astype(np.uint64) << np.uint64(32) | sources.place[at].astype(np.uint64)
            keys.sort()
            at = sources.named(keys)
            for k in range(0, len(at), ROWS):
                some = at[k : k + ROWS]
                columns = [pa.repeat(pa.scalar(name, pa.string()), len(some)), sources.name.take(pa.array(some)), pa.array(np.arange(k + 1, k + 1 + len(some), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["degraded", "source", "rank"])

    return _each(degraded, source, "degraded string, source string, rank int", give)


def scored(degraded: DataFrame, source: DataFrame) -> DataFrame:
    """degraded, source, ahash_distance, phash_distance, moment_distance, score of all candidates: those of match.candidates(), found where the item is."""

    def give(items: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for (name, a, p, moments, ratio), sources in items:
            classes, ahash, prints, of = sources.near(a)
            phash = sources.phashes(classes, p)[of]
            distance, score = sources.scores(prints, phash, moments)
            at, own = sources.passing(sources.begin, prints, ratio)
            for k in range(0, len(at), ROWS):
                some, its = at[k : k + ROWS], own[k : k + ROWS]
                numbers = [pa.array(x) for x in (ahash[of[its]], phash[its], distance[its], score[its])]
                columns = [pa.repeat(pa.scalar(name, pa.string()), len(some)), sources.name.take(pa.array(some)), *numbers]
                yield pa.RecordBatch.from_arrays(columns, ["degraded", "source", "ahash_distance", "phash_distance", "moment_distance", "score"])

    return _each(degraded, source, "degraded string, source string, ahash_distance int, phash_distance int, moment_distance float, score float", give)


def collapsed(degraded: DataFrame, source: DataFrame, slots: int | None = None) -> DataFrame:
    """degraded, kept: what match.collapsed() makes of the candidates, without a table of them."""

    def give(items: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, n, at = [], 0, None
        for (name, a, p, moments, ratio), sources in items:
            if held and (n >= ROWS or sources is not at):
                yield _kept(at, held)
                held, n = [], 0
            at, kept = sources, sources.kept(a, p, moments, ratio, slots)
            if len(kept[0]):
                held.append((name, a, p, *kept))
                n += len(kept[0])
        if held:
            yield _kept(at, held)

    return _each(degraded.where("filename IS NOT NULL"), source, f"degraded string, kept {KEPT}", give)


def _kept(sources: Sources, held: list[tuple]) -> pa.RecordBatch:
    """held: name, aHash, pHash, kept sources and their scores of items."""
    names, a, p, at, score = zip(*held)
    n, at, score = [len(x) for x in at], np.concatenate(at), np.concatenate(score)
    cls = sources.of_class[at]
    its_a, its_p = sources.a[cls], sources.p[cls]
    apart = lambda own, items: np.bitwise_count(own ^ np.repeat(np.array([(x or 0) & _BITS for x in items], np.uint64), n)).astype(np.int32)
    has_p = sources.has_p[cls]
    both = has_p & np.repeat(np.array([x is not None for x in p]), n)
    values = [score, sources.name.take(pa.array(at)), its_a.view(np.int64), pa.array(its_p.view(np.int64), mask=~has_p), sources.priority[at].astype(np.int32), apart(its_a, a), np.where(both, apart(its_p, p), 64).astype(np.int32)]
    structs = pa.StructArray.from_arrays([pa.array(v, kind) if isinstance(v, np.ndarray) else v for v, kind in zip(values, _KINDS)], _FIELDS)
    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(ends), structs)], ["degraded", "kept"])
