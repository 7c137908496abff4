"""Alignment of two tokenizers by the bytes at which their tokens end.

Every byte of a text has a label: no token ends there, one of A, one of B, or both. A regular expression
runs over the labels and takes spans up to each "both"; the labels in a span count its tokens, so that the
span is a group of A's and B's tokens over the same bytes. All A-B pairs of a group are links.

A text is cut into units at spaces where both tokenizers start anew whatever stands before (a space after
another character and before one that isn't white space): tokens of both end there, so no group crosses a unit, and the
labels of a text are those of its units, one after another. A worker remembers units that it has labelled.

How many documents hold a pair linked is counted in three steps. A task reads texts up to BATCH_BYTES: of
those it writes each document with the numbers of its units, the units with the numbers of their pairs, and
each different pair once with the number of documents among them. Spark adds up pairs over all batches,
finds the most frequent B of each A, and brings both figures back to the batches that hold the pair. There
they are summed over units, and these over documents. So pairs move once a batch, not once a
document, and nothing is broadcast but the two vocabularies.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.llm.bpe import PATTERN, byte_symbols, public_vocabulary
from slatewise.llm.common import saved, table
from slatewise.llm.pieces import SPACE, public_pieces, read_pieces
from slatewise.shipping import ship

#: Bytes of text of one batch: what one task holds at once, on both ways.
BATCH_BYTES = 8_000_000
#: Texts read, and new units encoded, at once; documents whose pairs are told apart at once.
AT_ONCE, DOCUMENTS = 200, 1000
#: Units that a worker remembers.
REMEMBERED = 300_000

UNIT = regex.compile(r"(?s).[^ ]*+(?:(?: (?!\S)| (?<=  ))[^ ]*+)*+")
NONE, A_END, B_END, BOTH = b".abx"
GROUP = re.compile(rb"[^x]*x")
_UNEVEN = re.compile(r" (?:\s|\Z)").search


def units_of(text: str) -> list[str]:
    """The units of a text, without the space before each."""
    if text[0] != " " and not _UNEVEN(text):
        return text.split(" ")  # each space stands after another character and before one that isn't white space
    return [u[1:] for u in UNIT.findall(" " + text)]


def labels(size: int, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """One label a byte: ".", "a", "b" or "x" for no end, A's, B's or both; the ends are places after a token's last byte."""
    out = np.full(size, NONE, np.uint8)
    out[a_ends - 1] = A_END
    at = out[b_ends - 1]
    out[b_ends - 1] = np.where(at == A_END, BOTH, B_END)
    return out.tobytes()


def groups(labelled: bytes) -> list[tuple[int, int]]:
    """Numbers of A's and B's tokens of each group, in order."""
    spans = GROUP.findall(labelled)
    shape = {span: (span.count(b"a") + 1, span.count(b"b") + 1) for span in set(spans)}
    return list(map(shape.__getitem__, spans))


class Tokenizers:
    """A and B as libraries encode, from the text of A's file and the bytes of B's.

    A's merges run in tiktoken, which takes a vocabulary whose ids rise with the ranks of merges, as those of such files do.
    """

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(a)["model"]
        vocab, symbols = spec["vocab"], byte_symbols()
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["merges"]]
        if made != sorted(made) or made and made[0] <= max(vocab[s] for s in symbols):
            raise ValueError("ids of A's vocabulary don't rise with its merges")
        of_symbol = {s: b for b, s in enumerate(symbols)}
        kept = {vocab[s] for s in symbols}.union(made)
        string = {i: bytes(map(of_symbol.get, t)) for t, i in vocab.items() if i in kept}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={x: i for i, x in string.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.a_bytes = [string.get(i, b"") for i in range(max(string) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text that starts with a space; B puts that space there itself."""
        return self.a.encode_ordinary(text), self.b.encode(text[1:])


class Units:
    """Units of texts with their tokens, groups and pairs, each worked out once."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.decimal = [str(i) for i in range(max(len(tokenizers.a_bytes), len(tokenizers.b_bytes)))]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (tokenizers.a_bytes, tokenizers.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str] = []
        self._parts: list[tuple[np.ndarray, ...]] = [(np.empty((0, 4), np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the units by number: tokens of A and B, groups and links; how many pairs; and the pairs of all, one after another."""
        if len(self._parts) > 1:
            self._parts = [tuple(np.concatenate(x) for x in zip(*self._parts))]
        return self._parts[0]

    def add(self, units: list[str]) -> None:
        """Learns new units, without the space before each. They are encoded as one text, in which both tokenizers end with each."""
        text = " " + " ".join(units)
        raw = text.encode()
        a_ids, b_ids = self.tokenizers.encode(text)
        if any(b"".join(map(t.__getitem__, x)) != raw for t, x in ((self.tokenizers.a_bytes, a_ids), (self.tokenizers.b_bytes, b_ids))):
            raise ValueError("a unit isn't given back by its tokens")
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_at, b_at = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        found = groups(labels(len(raw), a_at, b_at))
        n_a, n_b = np.array(found, np.int64).reshape(-1, 2).T
        last = np.cumsum([len(u.encode()) + 1 for u in units])
        to_a, to_b = np.searchsorted(a_at, last) + 1, np.searchsorted(b_at, last) + 1  # tokens up to the end of each unit
        of_a, of_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        a_end, b_end = np.cumsum(n_a), np.cumsum(n_b)
        ends = np.searchsorted(a_end, to_a) + 1  # and groups
        sides = list(map(self.decimal.__getitem__, a_ids)), list(map(self.decimal.__getitem__, b_ids))
        written, at_a, at_b = [], 0, 0
        for x, y in zip(a_end.tolist(), b_end.tolist()):
            written.append(",".join(sides[0][at_a:x]) + "|" + ",".join(sides[1][at_b:y]))
            at_a, at_b = x, y
        at = 0
        for unit, end in zip(units, ends.tolist()):
            self.number[unit] = len(self.written)
            self.written.append(";".join(written[at:end]))
            at = end
        of_token = np.repeat(n_b, n_a)  # each token of A meets all of B's in its group
        pairs = np.repeat(a, of_token) << 20 | b[_ranges(np.repeat(b_end - n_b, n_a), of_token)]
        links = np.diff(np.concatenate([[0], np.cumsum(n_a * n_b)])[np.concatenate([[0], ends])])
        shape = np.stack([of_a, of_b, np.diff(ends, prepend=0), links], axis=1)
        self._parts.append((shape, links, pairs))

    def of(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the units of each text, in order; none where tokens can't give a text back."""
        cut = [units_of(t) if t and SPACE not in t else [] for t in texts]
        known = self.number
        new = [u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in known]
        # what starts or ends a text with white space isn't cut off from a neighbour
        plain = [u for u in new if u and not u[0].isspace() and u[-1] != " "]
        for at in range(0, len(plain), AT_ONCE):
            self.add(plain[at : at + AT_ONCE])
        for u in new:
            if u not in known:
                self.add([u])
        return [list(map(known.__getitem__, units)) for units in cut]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each of the runs, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Batch:
    """Documents of one batch, and what they make together."""

    def __init__(self, units: Units):
        self.units, self.bytes = units, 0
        self.documents: list[tuple] = []
        self.numbers: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, ids: list, texts: list[str]) -> None:
        for doc_id, of in zip(ids, self.units.of(texts)):
            written = ";".join(map(self.units.written.__getitem__, of))
            numbers, counts = np.unique(np.array(of, np.int32), return_counts=True)
            self.documents.append((doc_id, hashlib.sha256(written.encode()).hexdigest() if of else ""))
            self.numbers.append(numbers)
            self.counts.append(counts.astype(np.int32))
        self.bytes += sum(map(len, texts))

    def rows(self, key: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Rows of the batch: its documents, then one with its units' pairs, then one with its pairs and their documents."""
        shape, sizes, all_pairs = self.units.tables()
        every = np.unique(np.concatenate([np.empty(0, np.int32), *self.numbers]))
        start = np.cumsum(sizes) - sizes
        own = all_pairs[_ranges(start[every], sizes[every])]
        pairs, place = np.unique(own, return_inverse=True)
        first = np.concatenate([[0], np.cumsum(sizes[every])]).astype(np.int64)
        held = np.zeros(len(pairs), np.int64)
        for at in range(0, len(self.numbers), DOCUMENTS):
            some, times = self.numbers[at : at + DOCUMENTS], self.counts[at : at + DOCUMENTS]
            unit, often = np.searchsorted(every, np.concatenate(some)), np.concatenate(times)
            ends = np.cumsum([0] + [len(x) for x in some])
            n = first[unit + 1] - first[unit]
            document = np.repeat(np.repeat(np.arange(len(some)), np.diff(ends)), n)
            both = np.unique(document * len(pairs) + place[_ranges(first[unit], n)])
            held += np.bincount(both % max(len(pairs), 1), minlength=len(pairs))
            totals = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(shape[every[unit]] * often[:, None], axis=0)])[ends], axis=0)
            ids, hashes = zip(*self.documents[at : at + DOCUMENTS])
            columns = [pa.array(ids, kind), *[pa.array(x, pa.int64()) for x in totals.T], pa.array(hashes, pa.string())]
            yield _record(key, 0, len(some), columns, _list(unit, ends, pa.int32()), _list(often, ends, pa.int32()), None)
        nothing = [pa.nulls(1, t) for t in [kind, *[pa.int64()] * 4, pa.string()]]
        yield _record(key, 1, 1, nothing, _list(place, [0, len(place)], pa.int32()), None, _list(first, [0, len(first)], pa.int64()))
        yield _record(key, 2, 1, nothing, None, _list(held, [0, len(held)], pa.int32()), _list(pairs, [0, len(pairs)], pa.int64()))


def _list(values: np.ndarray, ends, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _record(key, kind, n, columns, numbers, counts, longs) -> pa.RecordBatch:
    head = [pa.array([key] * n, pa.int64()), pa.array([kind] * n, pa.int32())]
    tail = [pa.nulls(n, pa.list_(t)) if x is None else x for x, t in ((numbers, pa.int32()), (counts, pa.int32()), (longs, pa.int64()))]
    return pa.RecordBatch.from_arrays([*head, *columns, *tail], ["batch", "kind", *COLUMNS, "numbers", "counts", "longs"])


_here: dict[str, Units] = {}


def _loaded(key: str, a: str, b: bytes) -> Units:
    if key not in _here:
        _here.clear()
        _here[key] = Units(Tokenizers(a, b))
    return _here[key]


def _summed(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """Both figures of each document of a batch, from those of the batch's pairs."""
    _here.clear()  # a worker that has labelled texts doesn't need their units any more
    kinds = documents["kind"].to_numpy()
    flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    whole, documents = documents.filter(pa.array(kinds == 1)), documents.filter(pa.array(kinds == 0))
    place, first = flat(whole, "numbers"), flat(whole, "longs")
    sums = []
    unit, often = flat(documents, "numbers"), flat(documents, "counts").astype(np.int64)
    ends = np.cumsum(np.concatenate([[0], pc.list_value_length(documents["numbers"]).to_numpy()])).astype(np.int64)
    for name in ("best", "held"):
        of_pair = np.zeros(pairs.num_rows, np.int64)
        of_pair[pairs["place"].to_numpy()] = pairs[name].to_numpy()
        of_unit = _runs(of_pair[place], first)
        sums.append(pa.array(_runs(often * of_unit[unit], ends), pa.int64()))
    return documents.select(COLUMNS).append_column("n_best", sums[0]).append_column("count_sum", sums[1])


def _runs(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between each two neighbouring ends."""
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])[ends])


def labelled(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Batches of docs (doc_id, text), written: rows of kind 0 are documents, 1 a batch's units, 2 its pairs. See aligned()."""
    ship(docs.sparkSession)
    spec = Path(a).read_text(encoding="utf-8"), Path(b).read_bytes()
    read_pieces(b)  # raises where units couldn't be told apart
    key = hashlib.sha256(repr(spec).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, number = _loaded(key, *sent.value), TaskContext.get().partitionId() << 32
        batch, kind = Batch(units), None
        for records in batches:
            kind = records.schema.field(0).type
            for at in range(0, records.num_rows, AT_ONCE):
                part = records.slice(at, AT_ONCE)
                batch.add(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
                if batch.bytes >= BATCH_BYTES or len(units.written) >= REMEMBERED:
                    yield from batch.rows(number, kind)
                    if len(units.written) >= REMEMBERED:
                        units.forget()
                    batch, number = Batch(units), number + 1
        if batch.documents:
            yield from batch.rows(number, kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"batch bigint, kind int, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    return saved(docs.select("doc_id", "text").mapInArrow(run, schema + ", numbers array<int>, counts array<int>, longs array<bigint>"))


def linked_pairs(batches: DataFrame) -> DataFrame:
    """pair (A's id << 20 | B's), held (documents that hold it linked) and best (1 if no B has more with that A), of labelled()."""
    pairs = batches.where("kind = 2").select(F.explode(F.arrays_zip(F.col("longs").alias("pair"), F.col("counts").alias("n"))).alias("x"))
    held = pairs.select("x.pair", "x.n").groupBy("pair").agg(F.sum("n").alias("held"))
    own = Window.partitionBy(F.shiftright("pair", 20))  # at most one row for each piece of B's vocabulary
    return held.withColumn("best", (F.col("held") == F.max("held").over(own)).cast("int"))


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs.

    a: path on the driver of a byte-level BPE file, which encodes a space and the text, strings of special tokens
    taken as they stand; b: path of a piece model, which puts that space there itself. A null or empty text, or one
    that the pieces don't give back (it holds U+2581, which they write as a space), has no tokens:
    zeros and an empty string. Repeated rows, and rows that share an id or have none, are documents of
    their own. An empty table gives no rows. Other columns are not looked at. One text is the least that a task
    holds.
    """
    batches = labelled(docs, a, b)
    found = saved(linked_pairs(batches))
    held = batches.where("kind = 2").select(F.col("batch").alias("of"), F.posexplode("longs").alias("place", "pair"))
    held = held.join(found, "pair").select("of", "place", "held", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    out = batches.where("kind < 2").groupBy("batch").cogroup(held.groupBy("of")).applyInArrow(_summed, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aligned() over all documents by the two public vocabularies."""
    return aligned(table(spark, sf_dir, "documents"), public_vocabulary(), public_pieces())
