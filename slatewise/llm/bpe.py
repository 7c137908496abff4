"""Byte-level BPE encoding and decoding.

A text is cut by the vocabulary file's pattern; the bytes of a piece form a doubly linked list of
symbols, and a heap holds the ranks of neighbouring pairs that can merge. The least rank is taken,
the leftmost at a tie; an entry whose symbols have changed since is stale and skipped. Decoding
concatenates the vocabulary's strings. The file is read by the driver (its size is bounded: a few
MB) and sent to the executors once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from slatewise.llm.common import table
from slatewise.shipping import ship

#: Fixed value: the published pattern that byte-level BPE cuts a text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 1_000_000
REMEMBERED_LENGTH = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in plain else chr(256 + sum(1 for x in range(b) if x not in plain)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank_of = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}.get
        self.made_of = {vocab[a] << 20 | vocab[b]: vocab[a + b] for a, b in pairs}
        of_symbol = {s: b for b, s in enumerate(byte_symbols())}
        self.first = [vocab[s] for s in byte_symbols()]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.string = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.string[i] = bytes(of_symbol[c] for c in token) if all(c in of_symbol for c in token) else token.encode()
        for token, i in added.items():
            self.string[i] = token.encode()
        self.added = added
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. A heap entry is rank << 32 | place; it is stale unless the pair at its place still has that rank."""
        rank_of, made_of = self.rank_of, self.made_of
        ids = list(map(self.first.__getitem__, piece))
        n = len(ids)
        ranks = list(map(rank_of, [a << 20 | b for a, b in zip(ids, ids[1:])]))
        ranks.append(None)
        heap = [r << 32 | i for i, r in enumerate(ranks) if r is not None]
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if ranks[i] != rank:
                continue  # stale
            j = after[i]
            ids[i] = made = made_of[ids[i] << 20 | ids[j]]
            ids[j], ranks[j] = -1, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                ranks[i] = r = rank_of(made << 20 | ids[k])
                if r is not None:
                    heapq.heappush(heap, r << 32 | i)
            else:
                ranks[i] = None
            h = before[i]
            if h >= 0:
                ranks[h] = r = rank_of(ids[h] << 20 | made)
                if r is not None:
                    heapq.heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _ids(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merge(piece.encode("utf-8", "replace")))
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        pieces, known = self.pieces(text), self.known
        found = list(map(known.get, pieces))
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = self._ids(pieces[k])
        return list(chain.from_iterable(found))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the strings of added tokens in it become their ids."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.string.__getitem__, ids)).decode("utf-8", "replace")


_here: dict[str, Bpe] = {}


def loaded(spec: str) -> Bpe:
    """The encoder of a file's text, made once in a worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _here:
        _here.clear()
        _here[key] = Bpe(spec)
    return _here[key]


def encoded(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs, and ids if keep_ids.

    vocabulary: path of the vocabulary file, on the driver. A null text counts as empty: no ids, and
    the hashes of nothing. Rows are taken one by one, so that repeated rows give repeated results, and
    an empty table gives none. Other columns are not looked at.
    """
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        decimal = [str(i) for i in range(len(bpe.string))]
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(at, 1000)
                n, hashes, decoded, kept = [], [], [], []
                for value in part.column(1):
                    ids = bpe.encode(value.as_py() or "")
                    n.append(len(ids))
                    hashes.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encoded() over all documents."""
    return encoded(table(spark, sf_dir, "documents"), public_vocabulary())
