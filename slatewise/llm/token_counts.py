"""Token counts without tokens: whole units that are one token, and merges for the rest.

Offline, on the driver, every string of the vocabulary that is one unit of the pre-tokenizer goes through
the merges once; those that come out as one token are proved to encode alone wherever the unit stands in a
text, since units never merge with each other. A worker counts units in that set as 1 without
looking at merges, and merges only the rest, whose counts it remembers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from slatewise.llm.bpe import REMEMBERED_LENGTH, Bpe
from slatewise.llm.common import table
from slatewise.llm.pieces import PieceBpe, public_pieces, read_pieces
from slatewise.shipping import ship

#: Units whose counts a worker remembers beside the proved ones.
REMEMBERED = 1_000_000
#: Texts read at a time.
AT_ONCE = 1000


class Counter:
    """Counts tokens of a text by one vocabulary: the text of a tokenizers file, or the pieces of a sentencepiece model."""

    def __init__(self, spec: str | list, alone: set[str] | None = None):
        self.coder = Bpe(spec) if isinstance(spec, str) else PieceBpe(spec)
        self.plain = self.coder.pieces if isinstance(spec, str) else self.coder.cut
        self.special = self.coder.special if isinstance(spec, str) else None
        self.encoded = (lambda u: self.coder.merge(u.encode("utf-8", "replace"))) if isinstance(spec, str) else self.coder._ids
        self.alone = dict.fromkeys(self.proved() if alone is None else alone, 1)
        self.known = dict(self.alone)

    def proved(self) -> set[str]:
        """The vocabulary's strings that are one unit and that the merges make one token."""
        if isinstance(self.coder, PieceBpe):
            one = lambda s: self.coder.units(s) == [s]
            return {s for s, i in self.coder.vocabulary.items() if one(s) and tuple(self.coder._ids(s)) == (i,)}
        found = set()
        for i, b in enumerate(self.coder.string):
            s = b.decode("utf-8", "ignore")
            if s and s.encode() == b and s not in self.coder.added and self.coder.pieces(s) == [s] and self.coder.merge(b) == [i]:
                found.add(s)
        return found

    def _units(self, text: str) -> int:
        units = self.plain(text)
        try:
            return sum(map(self.known.__getitem__, units))
        except KeyError:
            pass
        n, known = 0, self.known
        for u in units:
            one = known.get(u)
            if one is None:
                one = len(self.encoded(u))
                if len(u) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED + len(self.alone):
                        self.known = known = dict(self.alone)
                    known[u] = one
            n += one
        return n

    def count(self, text: str) -> int:
        """Tokens of a text; the strings of a tokenizers file's added tokens are one token each."""
        if self.special is None or not self.special.search(text):
            return self._units(text)
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += self._units(text[at : m.start()]) + 1
            at = m.end()
        return n + self._units(text[at:])


_here: dict[str, Counter] = {}


def _loaded(key: str, spec: str | list, alone: set[str]) -> Counter:
    if key not in _here:
        _here.clear()
        _here[key] = Counter(spec, alone)
    return _here[key]


def counted(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of each row of docs.

    vocabulary: path on the driver of a tokenizers file (.json, byte-level BPE) or a sentencepiece model
    (.model, BPE with byte fallback); its size is bounded, and it goes to the executors once. A null text
    counts as empty: no bytes, no tokens. Rows are counted one by one, so that repeated rows
    give repeated results and an empty table gives none; other columns are not looked at. A unit without a
    cut, however long, is merged whole by the heap in n log n steps.
    """
    ship(docs.sparkSession)
    spec = read_pieces(vocabulary) if vocabulary.endswith(".model") else open(vocabulary, encoding="utf-8").read()
    key = hashlib.sha256(repr(spec).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((spec, Counter(spec).proved()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded(key, *sent.value)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                sizes = pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64())
                n = [counter.count(t) for t in texts]
                columns = [part.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counted() over all documents by the public piece vocabulary."""
    return counted(table(spark, sf_dir, "documents"), public_pieces())
