"""Suffix-array dedup over bytes by a hash-compared suffix sort.

Repeated strings of WINDOW bytes are found span by span as in repeats.py. One copy of each different span of
a branching minimizer is read again, and the suffixes that start in these copies are sorted. Prefix
polynomial hashes give the common extension of two suffixes by binary search, so that a comparison takes
some log(WINDOW) hash look-ups, and a bottom-up mergesort runs all comparisons of a level at once.
Neighbours in the order whose extension reaches WINDOW are one string, which is verified byte by byte.

The copies of a minimizer's spans meet in one task, which sorts the suffixes of its block in groups with
one minimizer at one offset (equal strings share both). The first of a class stays and the others go.
Minimizers with thousands of spans are dealt over several blocks; the first of each class of these goes
on to Spark, keyed by minimizer and the SHA-256 of its bytes, for the first place over all blocks.

A span that has a copy as a whole has one suffix order for all its copies: they follow their first place,
and the bytes of both are compared by SHA-256 at their source coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import saved, table
from slatewise.llm.repeats import (
    Collision, Prefix, agrees, based, byte_arrays, compared, covered, hashes_at, mix, small, spans_found, symbol_table, units, until_agreed, whole_places,
)

WINDOW = 100
GRAM = 32
#: Spans of a minimizer in a block at most, on average; spans of a block, on average.
SALTED = 4096
BUCKET = 20_000


class Suffixes:
    """Suffixes of a byte string, by their first ``length`` bytes."""

    def __init__(self, values: np.ndarray, raw: np.ndarray, length: int):
        self.prefix, self.raw, self.length = Prefix(values), raw, length
        self.looks = 0
        self.agreed = True

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffixes a[i] and b[i], length at most, by binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        while (open_ := low < high).any():
            self.looks += 1
            mid = (low + high + 1) >> 1
            same = self.prefix.of(a, mid) == self.prefix.of(b, mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a[i] sorts before b[i]; equal ones don't."""
        e = self.extension(a, b)
        end = np.minimum(e, self.length - 1)
        return (e < self.length) & (self.raw[a + end] < self.raw[b + end])

    def sorted(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of suffixes by (group, suffix), stable; start is in order of group."""
        order = np.arange(len(start))
        first = np.searchsorted(group, group, side="left")
        size = np.searchsorted(group, group, side="right") - first
        rank = order - first  # place in its group
        width = 1
        most = int(size.max(initial=0))
        while width < most:
            # each element looks up how many of the sibling run come before it
            run = rank // (2 * width)
            left = (rank // width) % 2 == 0
            mine = run * 2 * width
            sibling = first + mine + np.where(left, width, 0)
            low = np.zeros(len(start), np.int64)
            high = np.clip(size - (mine + np.where(left, width, 0)), 0, width)
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                other = start[order[sibling[open_] + mid]]
                own = start[order[open_]]
                # stable: an equal one in the left run comes first
                before = np.where(left[open_], self.less(other, own), ~self.less(own, other))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            place = first + mine + (rank - mine - np.where(left, 0, width)) + low
            moved = np.empty_like(order)
            moved[place] = order
            order = moved
            width *= 2
        return order

    def classes(self, ordered: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A number for each of the sorted suffixes, equal for equal strings of one group; bytes are compared where hashes agree.

        agreed is False if strings with equal hashes differ: their order says nothing then.
        """
        new = np.ones(len(ordered), bool)
        if len(ordered) > 1:
            near = group[1:] == group[:-1]
            pairs = np.flatnonzero(near)
            full = pairs[self.extension(ordered[pairs], ordered[pairs + 1]) == self.length]
            for at in range(0, len(full), 1 << 16):
                some = full[at : at + (1 << 16)]
                inner = np.arange(self.length)
                same = (self.raw[ordered[some][:, None] + inner] == self.raw[ordered[some + 1][:, None] + inner]).all(axis=1)
                self.agreed &= bool(same.all())
                new[some[same] + 1] = False
        return np.cumsum(new)


def copies_read(base: DataFrame, spans: DataFrame, branching: DataFrame, k: int) -> DataFrame:
    """mini, salts, key, th, at, n, c, bytes: one copy of each span of a branching minimizer, read at its first place."""
    salted = branching.select("mini", F.ceil(F.col("d") / SALTED).cast("int").alias("salts"))
    copies = spans.join(salted, "mini").select("first.key", "first.th", F.struct("first.at", "n", "mini", "c", "salts").alias("copy"))
    per = copies.groupBy("key", "th").agg(F.collect_list("copy").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 100):
            raw, begun = byte_arrays(batch.column(2))
            lists = batch.column(3)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            at, n, mini, c, salts = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            key, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            low = begun[doc] + at
            data = raw.tobytes()
            taken = [data[a:b] for a, b in zip(low.tolist(), (low + n + k - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mini), pa.array(salts.astype(np.int32)), pa.array(key[doc]), pa.array(th[doc]), pa.array(at), pa.array(n.astype(np.int32)), pa.array(c), pa.array(taken, pa.binary())],
                ["mini", "salts", "key", "th", "at", "n", "c", "span"],
            )

    return base.join(per, ["key", "th"]).select("key", "th", "text", "copies").mapInArrow(run, "mini bigint, salts int, key bigint, th bigint, at bigint, n int, c bigint, span binary")


def resolved_block(block: pa.Table, k: int, m: int, table: np.ndarray) -> pa.Table:
    """Runs of windows of a block's copies that are found earlier in it; of salted minimizers the first of each class, open,
    which has to meet those of other blocks. A row with n = -1 says that equal hashes had different bytes."""
    mini, key, th, place, n, salts = (block.column(x).to_numpy().astype(np.int64) for x in ("mini", "key", "th", "at", "n", "salts"))
    order = np.lexsort((mini, place, th, key))
    # a row that comes twice is read twice: the same copy, not a later one
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (key, th, place, mini)], axis=0)
    order = order[new]
    mini, key, th, place, n, salts = (x[order] for x in (mini, key, th, place, n, salts))
    spans = pa.concat_arrays(block.column("span").chunks).take(pa.array(order)) if len(order) else pa.array([], pa.binary())
    raw, at = byte_arrays(spans)
    values = table[raw]
    start = at[:-1]
    # the minimizer is the leftmost gram of the span with its hash
    length = n + (k - m)
    begin = np.cumsum(length) - length
    where = np.repeat(start - begin, length) + np.arange(int(length.sum()))
    same = hashes_at(values, where, m) == np.repeat(mini.view(np.uint64), length)
    anchor = np.minimum.reduceat(np.where(same, where, np.iinfo(np.int64).max), begin) if len(begin) else begin
    # a window holds half of what surrounds the minimizer on one side at least: halves that are found once rule it out
    half = (k - m) // 2
    open_sides = []
    for first, fits in ((anchor - half, anchor - half >= start), (anchor, anchor + m + half <= start + n - 1 + k)):
        own = np.flatnonzero(fits)
        _, inverse, count = np.unique(hashes_at(values, first[own], m + half) ^ mix(mini[own].view(np.uint64)), return_inverse=True, return_counts=True)
        open_ = np.zeros(len(n), bool)
        open_[own] = count[inverse] > 1
        open_sides.append(open_ | (salts > 1))
    which = np.repeat(np.arange(len(n)), n)
    p = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(which))
    left, right = anchor[which] - p >= half, p + k - anchor[which] - m >= half
    use = (~left | open_sides[0][which]) & (~right | open_sides[1][which])
    which, p = which[use], p[use]
    # equal windows have their minimizer at one offset; copies are in order of place, and the sort is stable
    group = mini[which].view(np.uint64) ^ mix((anchor[which] - p).astype(np.uint64))
    order = np.argsort(group, kind="stable")
    which, p, group = which[order], p[order], group[order]
    suffixes = Suffixes(values, raw, k)
    by = suffixes.sorted(p, group)
    number = suffixes.classes(p[by], group[by])
    which, p = which[by], p[by]
    leads = np.append(True, number[1:] != number[:-1])[: len(number)]
    at_place = place[which] + p - start[which]
    # runs of neighbouring windows of one copy
    g = np.flatnonzero(~leads)
    g = g[np.lexsort((p[g], which[g]))]
    new = np.append(True, (which[g][1:] != which[g][:-1]) | (p[g][1:] != p[g][:-1] + 1))[: len(g)]
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(g)))
    g, u = g[first], np.flatnonzero(leads & (salts[which] > 1))
    both = np.concatenate([g, u])
    digests = [None] * len(g) + [hashlib.sha256(raw[x : x + k].tobytes()).digest() for x in p[u].tolist()]
    out = {
        "key": pa.array(key[which[both]], pa.int64()),
        "th": pa.array(th[which[both]], pa.int64()),
        "at": pa.array(at_place[both], pa.int64()),
        "n": pa.array(np.concatenate([runs, np.ones(len(u), np.int64)]), pa.int32()),
        "mini": pa.array(mini[which[both]], pa.int64()),
        "window": pa.array(digests, pa.binary()),
    }
    if not suffixes.agreed:
        out = {c: pa.array([-1 if c == "n" else None], x.type) for c, x in out.items()}
    return pa.table(out)


def repeated_places(base: DataFrame, k: int, m: int, seed: int) -> DataFrame:
    """key, th, at, n, rkey, rth, rat: windows that also start earlier; rkey is null where their bytes have been compared."""
    found, spans, branching = spans_found(base, True, k, m, seed)
    partitions = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions * 4, -(-spans.count() // BUCKET))
    salt = F.pmod(F.xxhash64("key", "th", "at"), F.col("salts"))
    dealt = copies_read(base, spans, branching, k).withColumn("bucket", F.pmod(F.xxhash64("mini", salt), F.lit(buckets)).cast("int"))
    symbols = symbol_table(seed)
    resolved = saved(
        dealt.groupBy("bucket").applyInArrow(lambda block: resolved_block(block, k, m, symbols), "key bigint, th bigint, at bigint, n int, mini bigint, window binary"), sweep=True
    )
    if not resolved.where("n < 0").isEmpty():
        raise Collision
    known = [F.lit(None).cast("long").alias(c) for c in ("rkey", "rth", "rat")]
    single = resolved.where("window IS NULL").select("key", "th", "at", "n", *known)
    # what is open, of salted minimizers only, meets by its bytes' SHA-256
    open_ = resolved.where("window IS NOT NULL")
    least = saved(open_.groupBy("mini", "window").agg(F.min(F.struct("key", "th", "at")).alias("first")))
    late = open_.join(least, ["mini", "window"]).where(F.struct("key", "th", "at") != F.col("first")).select("key", "th", "at", "n", *known)
    return whole_places(found, spans, keep_first=True).unionByName(single).unionByName(late)


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and kept (binary) if texts.

    A byte goes if it is in a string of ``window`` bytes that also starts earlier: in a document with a
    smaller id, or further left. A null text is empty. A row that comes twice with one id and text is
    no earlier than itself and stays; rows with one id and different texts are in order of a hash of
    the text. Cuts may split a character: what is kept is bytes. An empty table gives no rows. Other
    columns are not looked at.
    """
    base = based(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, wrong boolean" + ", kept binary" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw, spans = units(text.as_py(), True), spans.as_py()
                if spans:
                    gone = covered(len(raw), spans, window)
                    runs_of = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    rows.append((len(raw), int(gone.sum()), runs_of, hashlib.sha256(kept).hexdigest(), not agrees(raw, spans, window), kept))
                else:
                    rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), False, raw))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())[: 6 if texts else 5]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "wrong", "kept"][: 1 + len(kinds)])

    return until_agreed(lambda seed: compared(base, repeated_places(base, window, gram, seed), True, window).mapInArrow(run, schema))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deduplicated() over all documents."""
    return deduplicated(table(spark, sf_dir, "documents"), texts=False)
