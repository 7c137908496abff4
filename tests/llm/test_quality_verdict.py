"""Scores and verdicts of the quality rules against counts and ratios by plain loops."""

import collections
import math
import re

import pytest
import xxhash
from conftest import SF

from slatewise.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(*strings):
    h = 42
    for s in strings:
        h = xxhash.xxh64(s.encode(), seed=h).intdigest()
    return h


def grams(text):
    """Buckets of a text's words and of its pairs of neighbouring words."""
    w = WORD.findall(text or "")
    single = [hashed(x[-3:]) % quality.BUCKETS for x in w]
    pairs = [quality.PAIR_BUCKETS if a == b else hashed(a[-3:], b[-3:]) % quality.PAIR_BUCKETS for a, b in zip(w, w[1:])]
    return single, pairs


def judged_by_loops(texts, trusted):
    raw, good = (collections.Counter(), collections.Counter()), (collections.Counter(), collections.Counter())
    for i, t in texts:
        for k, found in enumerate(grams(t)):
            raw[k].update(found)
            if i in trusted:
                good[k].update(found)
    n, t = [sum(c.values()) for c in raw], [sum(c.values()) for c in good]
    out = {}
    for i, text in texts:
        single, pairs = grams(text)
        scores = [0.0, 0.0]
        if t[0] and single:
            scores[0] = sum(math.log((good[0][b] + 1) / (t[0] + quality.BUCKETS)) - math.log((raw[0][b] + 1) / (n[0] + quality.BUCKETS)) for b in single) / len(single)
        if t[1] and pairs:
            share = t[1] / n[1]
            scores[1] = sum(math.log((good[1][b] + quality.PRIOR * share) / (raw[1][b] + quality.PRIOR)) - math.log(share) for b in pairs) / len(pairs)
        out[i] = scores
    return out


def test_verdicts_are_those_of_the_loops(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    want = judged_by_loops(texts, trusted)
    got = quality.op7_quality(spark, SF).collect()
    assert len(got) == len(texts) and {r.kept for r in got} == {True, False}
    for r in got:
        score, pair_score = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-9) and r.pair_score == pytest.approx(pair_score, abs=1e-9)
        assert r.kept == (not r.base_failed and score >= quality.THRESHOLD and pair_score >= quality.PAIR_THRESHOLD)


def test_kept_documents_are_those_judged_kept_and_their_plan_stays_short(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.kept_documents(docs, labels)
    want = quality.judged(docs, labels).where("kept").select("doc_id").collect()
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in want)
    # the tables of ratios are in the plan once; each copy is more than a million characters
    assert len(kept._jdf.queryExecution().executedPlan().toString()) < 2_000_000
