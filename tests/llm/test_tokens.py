"""Token counts and alignment against the libraries, resampling against a loop."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from conftest import SF
from pyspark.sql import functions as F

from slatewise.llm import alignment, bpe, pieces, resampling, token_counts

SCHEMA = "doc_id bigint, text string, row bigint, part string, batch string, `n_words` string, kind int, held string, score string, copies int"
ALPHABET = "  ▁abAé\t\n\r\x00\x1c　中\U0001f642́<>'s-1ﬁ�\x85"


def hard_rows():
    r = random.Random(5)
    texts = [None, "", " ", "  a  b ", "a\tb\nc", "▁x", "<s>hi</s> <|endoftext|><0x41>", "word", "x" * 3000, "中" * 500, " " * 40 + "x", "\r\n" * 30]
    texts += ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(150)]
    texts += [" ".join(f"w{i % 977} the of" for i in range(12_000)), "the of and " * 30, "the of and " * 30]
    rows = [(i, t, 1, "p", "b", "n", 2, "h", "s", 3) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, "the end of it", *rows[0][2:]), (None, None, *rows[0][2:])]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def models():
    a = tokenizers.Tokenizer.from_file(bpe.public_vocabulary())
    return a, sentencepiece.SentencePieceProcessor(model_file=pieces.public_pieces())


def rows_sorted(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


COUNTED = ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def counts_of(rows, count, limit=4096):
    out = []
    for r in rows:
        n = count(r[1] or "")
        out.append((r[0], len((r[1] or "").encode()), n, n > limit))
    return sorted(out, key=repr)


def test_counts_pieces(spark, hard, empty, given, models):
    lib = lambda t: len(models[1].encode(t))
    assert rows_sorted(token_counts.counted(hard, pieces.public_pieces()), COUNTED) == counts_of(hard_rows(), lib)
    assert rows_sorted(token_counts.op12_token_counts(spark, SF), COUNTED) == counts_of(given, lib)
    assert token_counts.counted(empty, pieces.public_pieces()).count() == 0
    low = token_counts.counted(hard, pieces.public_pieces(), limit=3)
    assert rows_sorted(low, COUNTED) == counts_of(hard_rows(), lib, 3)


def test_counts_bytes(hard, models):
    lib = lambda t: len(models[0].encode(t, add_special_tokens=False).ids)
    models[0].encode_special_tokens = False
    assert rows_sorted(token_counts.counted(hard, bpe.public_vocabulary()), COUNTED) == counts_of(hard_rows(), lib)


def test_whole_tokens_are_proved(models):
    counter = token_counts.Counter(pieces.read_pieces(pieces.public_pieces()))
    assert len(counter.alone) > 31_000
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.public_pieces(), add_bos=False)
    proved = [p for p in counter.alone if p.startswith("▁") and len(p) > 1]
    assert all(len(ids) == 1 for ids in lib.encode([p[1:].replace("▁", " ") for p in proved if not p.startswith("▁▁")]))
    assert all(counter.coder.units(p) == [p] for p in counter.alone)


def aligned_brute(rows, a, b):
    """Groups by sets of ends, pairs by loops over groups."""
    a.encode_special_tokens = True
    symbols = {s: i for i, s in enumerate(bpe.byte_symbols())}
    a_bytes = lambda i: bytes(symbols[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    documents = []
    for _, t in rows:
        t = t or ""
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        strings = [list(map(a_bytes, ids[0])), list(map(b_bytes, ids[1]))]
        if any(b"".join(s) != (" " + t).encode() for s in strings):
            ids, strings = ([], []), ([], [])
        ends = [list(itertools.accumulate(map(len, s))) for s in strings]
        found, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            group = []
            for k in (0, 1):
                start = at[k]
                while at[k] < len(ends[k]) and ends[k][at[k]] <= end:
                    at[k] += 1
                group.append(ids[k][start : at[k]])
            found.append(group)
        documents.append((ids, found))
    held = collections.Counter()
    for _, found in documents:
        held.update({(x, y) for left, right in found for x in left for y in right})
    most = collections.defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), (ids, found) in zip(rows, documents):
        links = [(x, y) for left, right in found for x in left for y in right]
        written = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in found)
        digest = hashlib.sha256(written.encode()).hexdigest() if ids[0] else ""
        best = sum(held[p] == most[p[0]] for p in links)
        out.append((doc_id, len(ids[0]), len(ids[1]), len(found), len(links), best, sum(held[p] for p in links), digest))
    return sorted(out, key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark, hard, empty, given, models):
    got = rows_sorted(alignment.aligned(hard, bpe.public_vocabulary(), pieces.public_pieces()), ALIGNED)
    assert got == aligned_brute([r[:2] for r in hard_rows()], *models)
    assert rows_sorted(alignment.op13_alignment(spark, SF), ALIGNED) == aligned_brute(given, *models)
    assert alignment.aligned(empty, bpe.public_vocabulary(), pieces.public_pieces()).count() == 0


def test_alignment_in_many_batches(spark, models):
    """Small batches, and units forgotten between them."""
    want = aligned_brute([r[:2] for r in hard_rows()], *models)
    rows = [r[:2] for r in hard_rows()]
    parts = [rows[i::7] for i in range(7)]
    df = spark.createDataFrame([x for p in parts for x in p], "doc_id bigint, text string").repartition(7)
    assert rows_sorted(alignment.aligned(df, bpe.public_vocabulary(), pieces.public_pieces()), ALIGNED) == want
    units = alignment.Units(alignment.Tokenizers(open(bpe.public_vocabulary(), encoding="utf-8").read(), open(pieces.public_pieces(), "rb").read()))
    first = [units.written[n] for n in units.of(["the of and"])[0]]
    units.forget()
    assert first == [units.written[n] for n in units.of(["the of and"])[0]]


def test_labels_and_groups():
    import numpy as np

    labelled = alignment.labels(6, np.array([1, 3, 6]), np.array([3, 4, 6]))
    assert labelled == b"a.xb.x" and alignment.groups(labelled) == [(2, 1), (1, 2)]


def resampled_brute(rows, target, n, buckets=10_000, percent=10, least=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(lower))
    found = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    words = [split(t) for _, t in rows]
    features = [found(w) for w in words]
    s = collections.Counter(x for f in features for x in f)
    t = collections.Counter(x for text in target for x in found(split(text)))
    size_s, size_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (size_s + buckets) / ((s[b] + 1) * (size_t + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, _), w, f in zip(rows, words, features):
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able):
        r[4] = k + 1 if k < percent * len(able) // 100 else None
    return sorted((tuple(r[:4]) + (r[4] or None,) for r in out), key=repr)


DRAWN = ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("n,chunk", [(1, 1 << 16), (1, 50), (3, 1 << 16), (3, 64), (2, 0)])
def test_resampling(spark, hard, empty, given, n, chunk):
    """The same whatever the chunks: with chunks of some bytes every text is cut between all words."""
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(60).collect()] + [None, "the of and"]
    targets = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, doc_id int")
    rows = [r[:2] for r in hard_rows()] + given[:60]
    docs = hard.select("doc_id", "text", "row", "part").unionByName(spark.createDataFrame(given[:60], "doc_id bigint, text string"), allowMissingColumns=True)
    got = rows_sorted(resampling.resampled(docs, targets, n=n, percent=40, least_words=5, chunk=chunk), DRAWN)
    assert got == resampled_brute(rows, target, n, percent=40, least=5)


def test_resampling_empty(spark, hard, empty):
    assert resampling.resampled(empty, empty).count() == 0
    rows = resampling.resampled(hard, empty, percent=100).collect()
    assert len(rows) == len(hard_rows()) and any(r["rank"] for r in rows)
    assert all(r["rank"] is None for r in resampling.resampled(hard, hard, percent=0).collect())
    same = spark.createDataFrame([(1, "a b c")] * 50 + [(None, "a b c")] * 50, "doc_id bigint, text string")
    ranks = [r["rank"] for r in resampling.resampled(same, same, least_words=1, percent=70).select(F.col("rank")).collect()]
    assert sorted(x for x in ranks if x) == list(range(1, 71)) and ranks.count(None) == 30


def test_vocabulary_is_checked(tmp_path):
    assert public_tokenizers.path("piece_bpe_32k.model") == pieces.public_pieces()
    with pytest.raises(Exception):
        pieces.read_pieces(str(tmp_path / "none.model"))
