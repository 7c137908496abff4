"""Quality rules: log-likelihood ratio of a document's hashed n-grams under trusted text against the raw corpus.

Each word gives its trailing character trigram, which carries case, punctuation and word endings in
any language; trigrams are hashed into BUCKETS buckets. Each pair of neighbouring words gives the pair
of their trigrams, hashed into PAIR_BUCKETS buckets, with one more bucket for a word that follows itself,
since stutter repeats words of any kind. Two multinomials over each table, of all documents and of
trusted ones, give each bucket a log-likelihood ratio; that of a pair is smoothed by PRIOR more pairs of
the common ratio, so that pairs of a small corpus, most of which come once, say little. A document has two
scores, the means over its words and over its pairs. It is kept if its base rules hold and the scores reach THRESHOLD and PAIR_THRESHOLD,
constants: the verdict of one document depends on nothing but the count tables.

Trusted documents are those labelled quality = 1; the ids of at most TRUSTED of them (by a seeded
hash of the id) are used, so that the list can be broadcast. Counts of the raw corpus cover every
document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import bound, id_key, mixed, table, without_spaces, words

BUCKETS = 1 << 13
PAIR_BUCKETS = 1 << 16
TRUSTED = 20_000
TAIL = 3
THRESHOLD = -1.0
PAIR_THRESHOLD = -0.4
PRIOR = 8
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
WINDOW = 8


def _pairs(values: Column, gap: int, left: int, combine) -> Column:
    """combine(v[i], v[i + gap]) for every i, of an array with n - left such places."""
    n = F.greatest(F.size(values) - left, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + gap), n), combine)


def _tail(word: Column) -> Column:
    return F.substring(word, -TAIL, TAIL)


def bucket(word: Column) -> Column:
    """Of the trailing n-gram of a word, from 0."""
    return F.xxhash64(_tail(word)).bitwiseAND(BUCKETS - 1).cast("int")


def pair_bucket(a: Column, b: Column) -> Column:
    """Of the trailing n-grams of two neighbouring words, from 0; PAIR_BUCKETS where the words are the same."""
    return F.when(a == b, PAIR_BUCKETS).otherwise(F.xxhash64(_tail(a), _tail(b)).bitwiseAND(PAIR_BUCKETS - 1).cast("int"))


def repeated_words(ws: Column) -> Column:
    """Words inside windows of WINDOW words that are found twice or more in the text."""

    def count(h: Column) -> Column:
        places = F.sort_array(F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def among(s: Column) -> Column:
            n = F.size(s)
            same = _pairs(s, 1, 1, lambda a, b: a["h"] == b["h"])
            flagged = F.zip_with(
                s,
                F.zip_with(F.concat(F.array(F.lit(False)), same), F.concat(same, F.array(F.lit(False))), lambda a, b: a | b),
                lambda x, f: F.when(f, x["i"]),
            )
            starts = F.sort_array(F.array_compact(flagged))
            gaps = bound(starts, lambda p: _pairs(p, 1, 1, lambda a, b: F.least(b - a, F.lit(WINDOW))))
            return F.when(n > 0, F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g)).otherwise(0)

        return F.when(F.size(F.array_distinct(h)) < F.size(h), bound(places, among)).otherwise(0)

    def mix(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    def from_fours(h4: Column) -> Column:
        # without two equal windows of four there are no two of eight
        return F.when(F.size(F.array_distinct(h4)) < F.size(h4), bound(_pairs(h4, 4, 4, mix), count)).otherwise(0)

    single = F.transform(ws, lambda w: F.xxhash64(w))
    fours = bound(single, lambda h: bound(_pairs(h, 1, 1, mix), lambda h2: _pairs(h2, 2, 2, mix)))
    return bound(fours, from_fours).cast("long")


def _literal(ratios: list[float]) -> Column:
    """Folded to one literal array when the plan is optimised."""
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")


def _measures(ratios: list[float], pair_ratios: list[float]):
    """From an array of words to (n, r, failed, score, pair_score): how many, how many repeat, and how they fare."""
    literal, pair_literal = _literal(ratios), _literal(pair_ratios)

    def totals(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda acc, x: acc + F.element_at(literal, bucket(x) + 1))
        pairs = F.aggregate(_pairs(w, 1, 1, pair_bucket), F.lit(0.0), lambda acc, b: acc + F.element_at(pair_literal, b + 1))
        return F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"), total.alias("total"), pairs.alias("pairs"))

    def scores(x: Column) -> Column:
        n, r = x["n"], x["r"]
        return F.struct(
            n.alias("n"),
            r.alias("r"),
            ((n < LEAST_WORDS) | (100 * r > 30 * n)).alias("failed"),
            F.when(n > 0, x["total"] / n).otherwise(0.0).alias("score"),
            F.when(n > 1, x["pairs"] / (n - 1)).otherwise(0.0).alias("pair_score"),
        )

    return lambda w: bound(bound(w, totals), scores)


def _passes(failed: Column, score: Column, pair_score: Column, threshold: float, pair_threshold: float) -> Column:
    return (~failed) & (score >= threshold) & (pair_score >= pair_threshold)


def features(docs: DataFrame, ratios: list[float], pair_ratios: list[float]) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and pair_score; columns of these names are replaced."""
    text = F.coalesce("text", F.lit(""))
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "pair_score")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(without_spaces(x)) > 0)
    out = docs.select(
        *others,
        _measures(ratios, pair_ratios)(words(F.col("text"))).alias("_per"),
        F.length(without_spaces(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    per = F.col("_per")
    return out.select(
        *others,
        per["n"].alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        per["r"].alias("n_repeat_words"),
        per["failed"].alias("base_failed"),
        per["score"].alias("score"),
        per["pair_score"].alias("pair_score"),
    )


def bucket_ratios(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> tuple[list[float], list[float]]:
    """Log-likelihood ratio of each bucket of words, add-one smoothed, and of pairs; 0.0 everywhere where nothing is trusted.

    Labels of one document that contradict each other don't make it trusted.
    """
    good = labels.groupBy(id_key(F.col("doc_id")).alias("_key")).agg(F.min("quality").alias("_q")).where("_q = 1")
    good = good.orderBy(mixed(F.col("_key"), 3), "_key").limit(trusted).select("_key", F.lit(1).alias("_good"))
    base = docs.select(id_key(F.col("doc_id")).alias("_key"), words(F.col("text")).alias("_w"))
    grams = F.concat(F.transform("_w", bucket), _pairs(F.col("_w"), 1, 1, lambda a, b: pair_bucket(a, b) + BUCKETS))
    rows = base.join(F.broadcast(good), "_key", "left").select(F.coalesce("_good", F.lit(0)).alias("_good"), F.explode(grams).alias("b"))
    counted = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("_good").alias("t")).collect()
    n, t = {r[0]: r[1] for r in counted}, {r[0]: r[2] for r in counted}
    all_n, all_t = (sum(counts.get(b, 0) for b in range(BUCKETS)) for counts in (n, t))
    single = [0.0] * BUCKETS
    if all_t:
        single = [math.log((t.get(b, 0) + 1) / (all_t + BUCKETS)) - math.log((n.get(b, 0) + 1) / (all_n + BUCKETS)) for b in range(BUCKETS)]
    table = range(BUCKETS, BUCKETS + PAIR_BUCKETS + 1)
    all_n, all_t = (sum(counts.get(b, 0) for b in table) for counts in (n, t))
    if not all_t:
        return single, [0.0] * len(table)
    share = all_t / all_n
    return single, [math.log((t.get(b, 0) + PRIOR * share) / (n.get(b, 0) + PRIOR)) - math.log(share) for b in table]


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, pair_threshold: float = PAIR_THRESHOLD) -> DataFrame:
    """docs with the columns of features() and kept.

    Null and empty texts have no words: they fail the base rules and score 0, as one word does for its pairs. Repeated rows are
    judged alike. An empty table gives no rows; without trusted documents the base rules decide.
    """
    out = features(docs, *bucket_ratios(docs, labels))
    return out.withColumn("kept", _passes(F.col("base_failed"), F.col("score"), F.col("pair_score"), threshold, pair_threshold))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, pair_threshold: float = PAIR_THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that judged() keeps.

    The verdict is one expression: a condition on columns of judged() would be taken apart, pushed below them and
    computed, tables of ratios and all, once for each column that it names.
    """
    measures = _measures(*bucket_ratios(docs.select("doc_id", "text"), labels))
    return docs.where(bound(measures(words(F.col("text"))), lambda per: _passes(per["failed"], per["score"], per["pair_score"], threshold, pair_threshold)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judged() over all documents and labels."""
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "pair_score")
