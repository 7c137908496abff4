"""Repeated windows of K symbols over all documents, found without a row per window.

Consecutive windows with one minimizer (the least hashed m-gram in the window, the leftmost at a tie)
make one span, a row of about (K - m) / 2 windows. Equal windows have equal minimizers, so that Spark
joins can work on spans:

1. Spans whose minimizer is found once have no repeated window and go.
2. Equal spans (minimizer and hash of all symbols) are counted, with their first place. A minimizer with
   one span is nonbranching: all windows of its spans repeat together.
3. Where a minimizer has several spans, it branches, and one copy of each span is read again from its
   source coordinates for its windows to be compared. How is left to the operator.

Counts and first places are sums and minima that Spark combines before it shuffles, and what they say
comes back by joins with written tables: a minimizer in a third of all documents has no task of its own.

Hashes only propose. Places that repeat an earlier one along one diagonal are joined to long spans, and
both ends of each are read at their source coordinates: their SHA-256 has to agree. Equal strings always
have equal hashes, so nothing is missed; a pair that agrees by hash alone is seen here, and all is done
again with another seed. Rows with one doc_id are told apart by a 64-bit hash of their whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import SPACES, discard, finished, id_key, saved
from slatewise.shipping import ship

#: Symbols that are worked on at once; longer texts go in overlapping pieces.
CHUNK = 1 << 19
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
#: Texts whose symbols are made at once.
ROWS = 2000
#: Hash seeds that are tried.
SEEDS = 8


class Collision(Exception):
    """Places that agree by hash and not by their symbols."""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def symbol_table(seed: int) -> np.ndarray:
    """A symbol for each byte."""
    return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 257)) * _R)


_BYTE = symbol_table(0)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n places."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_R, _RINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


class Prefix:
    """Prefix polynomial hashes of a run of symbols: the hash of any part in constant time."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def byte_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each value starts and the last ends; null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def byte_symbols(column: pa.Array, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    raw, at = byte_arrays(column)
    return table[raw], at


_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True


def word_symbols(column: pa.Array, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and at which word each value starts."""
    raw, at = byte_arrays(column)
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begun = at[:-1][at[:-1] < len(raw)]
    first[begun] = inside[begun]  # a text starts a word of its own
    starts = np.flatnonzero(first)
    # a word ends at the next white space or text
    stops = np.append(np.flatnonzero(~inside), len(raw))
    ends = stops[np.searchsorted(stops, starts)]
    borders = np.append(at[1:], len(raw))
    ends = np.minimum(ends, borders[np.searchsorted(borders, starts, side="right")])
    hashes = np.empty(len(starts), np.uint64)
    at_word = 0
    while at_word < len(starts):  # pieces of some CHUNK bytes
        to = max(at_word + 1, int(np.searchsorted(starts, starts[at_word] + CHUNK)))
        low, high = starts[at_word], ends[to - 1]
        prefix = Prefix(table[raw[low:high]])
        s = starts[at_word:to] - low
        length = ends[at_word:to] - starts[at_word:to]
        hashes[at_word:to] = mix(prefix.of(s, length) + length.astype(np.uint64))
        at_word = to
    return hashes, np.searchsorted(starts, at)


def paths(symbols: np.ndarray, at: np.ndarray, k: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(minimizer, span, start, windows) of the paths of texts laid end to end, piece by piece."""
    w = k - m + 1
    ends = at[1:]
    for low in range(0, len(symbols) - k + 1, CHUNK):
        part = symbols[low : low + CHUNK + k - 1]
        n = len(part) - k + 1
        prefix = Prefix(part)
        grams = mix(prefix.of(np.arange(len(part) - m + 1), m))
        keys = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)  # 20 bits for the place: CHUNK + k fits
        blocks = -(-len(keys) // w)
        padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keys)] = keys
        grid = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        where = (least & np.uint64(0xFFFFF)).astype(np.int64)
        p = np.arange(low, low + n)
        text_end = ends[np.searchsorted(ends, p, side="right")]
        valid = np.flatnonzero(p + k <= text_end)
        if not len(valid):
            continue
        a = where[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(valid)))
        start = valid[first]
        length = count + (k - 1)
        yield grams[a[first]], mix(prefix.of(start, length) + length.astype(np.uint64)), start + low, count


def based(docs: DataFrame) -> DataFrame:
    """doc_id, key, th, text: th is a hash of the whole text where rows share an id, and 0 everywhere where none do."""
    key, th = id_key(F.col("doc_id")).alias("key"), F.xxhash64("text")
    several = docs.select(key, th.alias("th")).groupBy("key").agg(F.min("th").alias("low"), F.max("th").alias("high")).where("low <> high")
    th = F.lit(0).cast("long") if several.isEmpty() else th
    return docs.select("doc_id", key, th.alias("th"), F.col("text").cast("string").alias("text"))


def symbols_of(is_bytes: bool, seed: int) -> Callable:
    table = symbol_table(seed)
    return lambda column: (byte_symbols if is_bytes else word_symbols)(column, table)


def units(text: str | None, is_bytes: bool) -> bytes | list[bytes]:
    """Bytes of a text, or its words."""
    raw = (text or "").encode()
    return raw if is_bytes else raw.split()  # bytes.split() parts at the same six characters


def part(own: bytes | list[bytes], start: int, stop: int) -> bytes:
    return own[start:stop] if isinstance(own, bytes) else b" ".join(own[start:stop])


def spans_found(base: DataFrame, is_bytes: bool, k: int, m: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """found (mini, span, key, th, at, n): all spans whose minimizer is found twice; spans (mini, span, c, first, n): the
    different ones, counted, with their first place (key, th, at); branching (mini, d): minimizers of d > 1 spans."""
    ship(base.sparkSession)
    symbols = symbols_of(is_bytes, seed)

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, ROWS):
            for mini, _, _, _ in paths(*symbols(batch.column(0)), k, m):
                yield pa.RecordBatch.from_arrays([pa.array(mini.view(np.int64))], ["mini"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, ROWS):
            values, at = symbols(batch.column(2))
            key, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for mini, span, start, count in paths(values, at, k, m):
                doc = np.searchsorted(at, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini.view(np.int64)), pa.array(span.view(np.int64)), pa.array(key[doc]), pa.array(th[doc]), pa.array(start - at[doc]), pa.array(count.astype(np.int32))],
                    ["mini", "span", "key", "th", "at", "n"],
                )

    # written, so that the join below has a plain exchange on both sides and Spark can split a hot minimizer
    shared = base.select("text").mapInArrow(minimizers, "mini bigint").groupBy("mini").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mini")
    shared = saved(shared, sweep=True)
    found = base.select("key", "th", "text").mapInArrow(rows, "mini bigint, span bigint, key bigint, th bigint, at bigint, n int").join(shared, "mini")
    found = saved(found, sweep=True)
    spans = saved(found.groupBy("mini", "span").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "th", "at")).alias("first"), F.min("n").alias("n")), sweep=True)
    branching = saved(spans.groupBy("mini").agg(F.count(F.lit(1)).alias("d")).where("d > 1"))
    discard(shared)
    return found, spans, branching


def whole_places(found: DataFrame, spans: DataFrame, keep_first: bool) -> DataFrame:
    """key, th, at, n, rkey, rth, rat: places of spans that are found twice, and the first place that each repeats."""
    many = saved(spans.where("c > 1").select("mini", "span", "first"))
    whole = found.join(many, ["mini", "span"])
    if keep_first:
        whole = whole.where(F.struct("key", "th", "at") != F.col("first"))
    return whole.select("key", "th", "at", "n", F.col("first.key").alias("rkey"), F.col("first.th").alias("rth"), F.col("first.at").alias("rat"))


def long_spans(places: DataFrame) -> DataFrame:
    """places with those of one document that go on along one diagonal joined: rows of long spans."""
    per = places.groupBy("key", "th").agg(F.collect_list(F.struct("at", "n", "rkey", "rth", "rat")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            at, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            sure = flat.field(2).is_null().to_numpy(zero_copy_only=False)
            rkey, rth, rat = (flat.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4))
            along = np.where(sure, 0, at - rat)
            order = np.lexsort((at, along, rth, rkey, sure, doc))
            columns = [x[order] for x in (doc, sure, rkey, rth, along)]
            at, n = at[order], n[order]
            new = np.ones(len(order), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0) | (at[1:] != at[:-1] + n[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first) if len(first) else first
            doc, sure, rkey, rth, along = (x[first] for x in columns)
            key, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            # a place that is its own first needs no look
            sure |= (rkey == key[doc]) & (rth == th[doc]) & (along == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[doc]), pa.array(th[doc]), pa.array(at[first]), pa.array(total), *(pa.array(x, pa.int64(), mask=sure) for x in (rkey, rth, at[first] - along))],
                ["key", "th", "at", "n", "rkey", "rth", "rat"],
            )

    return per.mapInArrow(run, "key bigint, th bigint, at bigint, n bigint, rkey bigint, rth bigint, rat bigint")


def compared(base: DataFrame, places: DataFrame, is_bytes: bool, k: int) -> DataFrame:
    """doc_id, text, spans of each row of base: spans (at, n, digest) of windows, digest what the place that they repeat holds, null where that is known."""
    spans = saved(long_spans(places), sweep=True)
    asked = spans.where("rkey IS NOT NULL").select("rkey", "rth", "rat", "n").distinct()
    lists = asked.groupBy(F.col("rkey").alias("key"), F.col("rth").alias("th")).agg(F.collect_list(F.struct("rat", "n")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = units(batch.column(2)[row].as_py(), is_bytes)
                asked = batch.column(3)[row].as_py()
                size = len(asked)
                columns = [pa.array([batch.column(i)[row].as_py()] * size, pa.int64()) for i in (0, 1)]
                digests = [hashlib.sha256(part(own, x["rat"], x["rat"] + x["n"] - 1 + k)).digest() for x in asked]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([x["rat"] for x in asked], pa.int64()), pa.array([x["n"] for x in asked], pa.int64()), pa.array(digests, pa.binary())], ["rkey", "rth", "rat", "n", "digest"]
                )

    read = base.join(lists, ["key", "th"]).select("key", "th", "text", "asked").mapInArrow(run, "rkey bigint, rth bigint, rat bigint, n bigint, digest binary")
    digests = saved(read.groupBy("rkey", "rth", "rat", "n").agg(F.min("digest").alias("digest")), sweep=True)
    per = spans.join(digests, ["rkey", "rth", "rat", "n"], "left").groupBy("key", "th").agg(F.collect_list(F.struct("at", "n", "digest")).alias("spans"))
    return base.join(per, ["key", "th"], "left").select("doc_id", "text", "spans")


def agrees(own: bytes | list[bytes], spans: list[dict], k: int) -> bool:
    """Whether a document's spans hold what the places that they repeat hold."""
    return all(x["digest"] is None or hashlib.sha256(part(own, x["at"], x["at"] + x["n"] - 1 + k)).digest() == x["digest"] for x in spans)


def until_agreed(attempt: Callable[[int], DataFrame]) -> DataFrame:
    """attempt(seed), a table with a column wrong, of the first seed whose rows are all right; without that column."""
    for seed in range(SEEDS):
        try:
            done = finished(lambda: attempt(seed))  # noqa: B023
        except Collision:
            continue
        if done.where("wrong").isEmpty():
            return done.drop("wrong")
        discard(done)
    raise Collision(f"hashes with {SEEDS} seeds")


def hashes_at(values: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of so many symbols at each place, all of which lie inside."""
    out = np.empty(len(start), np.uint64)
    piece = start // CHUNK
    for x in np.unique(piece):
        mine = piece == x
        low = int(x) * CHUNK
        out[mine] = mix(Prefix(values[low : low + CHUNK + length]).of(start[mine] - low, length))
    return out


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def covered(n: int, spans: list[dict] | None, k: int) -> np.ndarray:
    """Which of n symbols are in a window of the runs."""
    edge = np.zeros(n + 1, np.int32)
    for x in spans or ():
        a, b = min(x["at"], n), min(x["at"] + x["n"] - 1 + k, n)
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:n]) > 0
