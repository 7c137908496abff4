"""Toxicity by a weighted grammar of composed finite-state transducers over clauses.

Words become symbols: insult (with its level), threat, target, negation, report, or other. Insults are
learned from labelled documents: whole words, and stems of STEMS letters, that toxic documents hold
far more often than others; short lists of threats, targets, negations and words of reported speech in
four languages are given. Five transducers, each a table of states and weighted arcs (symbol in, symbol
out, weight, next state), rewrite the symbols of a clause:

    insult    an insult within NEAR words after another one rises by a level
    threat    a threat with a target within NEAR words on either side -> an aimed threat
    target    an insult with a target within NEAR words on either side -> an aimed insult
    negation  what comes within NEAR words after a negation -> its negated form, NEGATED times the weight
    report    everything in a clause that has a word of reported speech anywhere -> its reported form

They are composed to one transducer (states are tuples, made when a clause first reaches them). A clause
can only be judged when its end is known, so threat, target and report guess what follows and drop the
paths whose guess fails: every clause has exactly one path, and its weight, the sum of its arcs, is the
clause's. A document's weight is the sum over clauses; its logarithm passes through a logistic curve
fitted to the labelled documents. Clauses without an insult or threat weigh 0 and are not run.

What an aim adds, what a negation or a report leaves and what a threat without an aim weighs are learned too, where
labels say anything about it: the forms in which the labelled documents hold insults and threats are counted, and a
weight moves from its given value if the curve's likelihood rises by EVIDENCE at least.

Labels come only from documents whose crc32 of the id mod 5 is not 0, at most LABELLED of them (by a
hash of the id): a bound on what the driver and the broadcast hold. Every document is scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import id_key, mixed, saved, table
from slatewise.shipping import ship

LABELLED = 20_000
STEMS = (4, 5, 6)
LEAST_TOXIC = 3
LEAST_ODDS = 20
#: A level of an insult, and the highest one.
LEVEL, LEVELS = 0.25, 8
TARGETED, NEGATED, REPORTED, THREAT, UNAIMED = 0.5, 0.4, 0.5, 1.0, 0.5
NEAR = 3
#: Rise of the log-likelihood for which a weight leaves its given value, and the values that are tried.
EVIDENCE = 2.0
TRIED = {"targeted": (0.0, 0.25, 0.5, 1.0, 2.0), "negated": (0.0, 0.2, 0.4, 0.7, 1.0), "reported": (0.0, 0.2, 0.5, 0.8, 1.0), "unaimed": (0.0, 0.25, 0.5, 1.0)}


class Weights(NamedTuple):
    """Weights of arcs: what an aim adds to an insult, what negation and report leave, and a threat without a target."""

    targeted: float = TARGETED
    negated: float = NEGATED
    reported: float = REPORTED
    unaimed: float = UNAIMED


GIVEN = Weights()

# Short word lists of the grammar.
TARGETS = frozenset("you your you're youre u ur he she they them him her these those tu te toi vous votre ton il elle ils du dich dir ihr euch dein deine er sie tú usted ustedes te ti él ella ellos".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't doesn't nobody nicht nie kein keine niemals ne pas jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says say claimed reported quoted wrote told called according allegedly sagte sagt schrieb laut dit disait selon écrit dijo dice según escribió".split())
THREATS = frozenset("kill murder hurt stab shoot beat destroy töten umbringen töte tuer frapper détruire matar golpear destruir".split())

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def features_of(text: str) -> set[str]:
    """Words, and stems marked by a trailing *, of a text."""
    found = set(_WORD.findall(text.lower()))
    return found | {f"{w[:n]}*" for w in found for n in STEMS if len(w) > n}


class Transducer:
    """Starts, final states and arcs: arcs[state, symbol in] is a list of (symbol out, weight, next state)."""

    def __init__(self, starts: list, arcs: dict, final: set):
        self.starts, self.table, self.final = starts, arcs, final

    def arcs(self, state, symbol: str) -> list:
        return self.table.get((state, symbol), [])

    def accepts(self, state) -> bool:
        return state in self.final


class Composed:
    """The composition of two transducers: what the first writes the second reads. Arcs are made once, when they are asked for."""

    def __init__(self, first, second):
        self.first, self.second = first, second
        self.starts = [(a, b) for a in first.starts for b in second.starts]
        self.made: dict = {}

    def arcs(self, state, symbol: str) -> list:
        found = self.made.get((state, symbol))
        if found is None:
            a, b = state
            found = self.made[state, symbol] = [
                (out, w1 + w2, (to_a, to_b)) for middle, w1, to_a in self.first.arcs(a, symbol) for out, w2, to_b in self.second.arcs(b, middle)
            ]
        return found

    def accepts(self, state) -> bool:
        return self.first.accepts(state[0]) and self.second.accepts(state[1])


def weigh(machine, symbols: list[str]) -> float:
    """Weight of the heaviest accepted path; the grammar's transducers have one path for each clause."""
    now = dict.fromkeys(machine.starts, 0.0)
    for symbol in symbols:
        after: dict = {}
        for state, weight in now.items():
            for _, w, to in machine.arcs(state, symbol):
                if after.get(to, -math.inf) < weight + w:
                    after[to] = weight + w
        now = after
    return max((w for state, w in now.items() if machine.accepts(state)), default=0.0)


#: Symbols: o(ther), y (target), n(egation), r(eport), t(hreat), i1, i2, ... (insults); T and I are aimed, ~ negated.
INSULTS = [f"i{k}" for k in range(1, LEVELS + 1)]
AIMED = [f"I{k}" for k in range(1, LEVELS + 1)]
PLAIN = ["o", "y", "n", "r"]


def read(machine, symbols: list[str]) -> list[str]:
    """The symbols that the heaviest accepted path writes."""
    now: dict = {s: (0.0, []) for s in machine.starts}
    for symbol in symbols:
        after: dict = {}
        for state, (weight, written) in now.items():
            for out, w, to in machine.arcs(state, symbol):
                if to not in after or after[to][0] < weight + w:
                    after[to] = weight + w, [*written, out] if out not in PLAIN else written
        now = after
    return max(((w, out) for s, (w, out) in now.items() if machine.accepts(s)), default=(0.0, []))[1]


def value(symbol: str, weights: Weights = GIVEN) -> float:
    """What a symbol weighs before reported speech is known."""
    if symbol[0] == "~":
        return weights.negated * value(symbol[1:], weights)
    if symbol in PLAIN:
        return 0.0
    if symbol[0] in "tT":
        return THREAT if symbol == "T" else weights.unaimed
    return LEVEL * int(symbol[1:]) + (weights.targeted if symbol[0] == "I" else 0.0)


def insult_transducer() -> Transducer:
    """State: words for which an insult still raises the next one."""
    arcs = {}
    for state in range(NEAR + 1):
        for x in [*PLAIN, "t"]:
            arcs[state, x] = [(x, 0.0, max(state - 1, 0))]
        for k in range(1, LEVELS + 1):
            out = f"i{min(k + 1, LEVELS)}" if state else f"i{k}"
            arcs[state, f"i{k}"] = [(out, value(out), NEAR)]
    return Transducer([0], arcs, set(range(NEAR + 1)))


def aiming_transducer(kinds: dict[str, str], others: list[str], base: float = 0.0, weights: Weights = GIVEN) -> Transducer:
    """Rewrites the symbols of kinds that have a target within NEAR words on either side to their aimed form.

    State: (words that the last target still reaches, words that must hold no target, words by which one must come).
    base is the weight of a rewritten or kept symbol that no transducer before gave it.
    """
    arcs: dict = {}
    start = (0, 0, 0)
    todo, known = [start], {start}

    def passed(state):
        """The state after a word that is no target; None where a promised target is overdue."""
        reach, none, due = state
        return None if due == 1 else (max(reach - 1, 0), max(none - 1, 0), max(due - 1, 0))

    while todo:
        state = todo.pop()
        found = []
        after = passed(state)
        for x in others:
            if x == "y":
                if not state[1]:
                    found.append((x, x, 0.0, (NEAR, 0, 0)))
            elif after:
                found.append((x, x, 0.0, after))
        for x, aimed in kinds.items():
            if not after:
                continue
            kept, risen = base * value(x, weights), value(aimed, weights) - (1 - base) * value(x, weights)
            if state[0]:
                found.append((x, aimed, risen, after))
            else:
                found.append((x, aimed, risen, (after[0], after[1], after[2] or NEAR)))
                if not after[2]:
                    found.append((x, x, kept, (after[0], NEAR, 0)))
        for symbol, out, weight, to in found:
            arcs.setdefault((state, symbol), []).append((out, weight, to))
            if to not in known:
                known.add(to)
                todo.append(to)
    return Transducer([start], arcs, {s for s in known if not s[2]})


def negation_transducer(weights: Weights = GIVEN) -> Transducer:
    """State: words that the last negation still reaches."""
    arcs = {}
    for state in range(NEAR + 1):
        for x in PLAIN:
            arcs[state, x] = [(x, 0.0, NEAR if x == "n" else max(state - 1, 0))]
        for x in [*INSULTS, *AIMED, "t", "T"]:
            out = f"~{x}" if state else x
            arcs[state, x] = [(out, value(out, weights) - value(x, weights), max(state - 1, 0))]
    return Transducer([0], arcs, set(range(NEAR + 1)))


def report_transducer(weights: Weights = GIVEN) -> Transducer:
    """States: direct speech; reported speech whose report word is still to come; reported speech."""
    arcs = {}
    loaded = [*INSULTS, *AIMED, "t", "T"]
    for x in [*PLAIN, *loaded, *(f"~{x}" for x in loaded)]:
        if x != "r":
            arcs["direct", x] = [(x, 0.0, "direct")]
        for state in ("coming", "reported"):
            arcs[state, x] = [(f'"{x}', (weights.reported - 1) * value(x, weights), "reported" if x == "r" else state)]
    return Transducer(["direct", "coming"], arcs, {"direct", "reported"})


def transducers(weights: Weights = GIVEN) -> list[Transducer]:
    """The five in the order in which they are composed."""
    return [
        insult_transducer(),
        aiming_transducer({"t": "T"}, [*PLAIN, *INSULTS], 1.0, weights),
        aiming_transducer(dict(zip(INSULTS, AIMED)), [*PLAIN, "t", "T"], 0.0, weights),
        negation_transducer(weights),
        report_transducer(weights),
    ]


def composed(parts: list):
    out = parts[0]
    for p in parts[1:]:
        out = Composed(out, p)
    return out


class Grammar:
    """Symbols of words by a lexicon (words, and stems with a trailing *, with their weights) and the composed transducers."""

    def __init__(self, lexicon: dict[str, float], slope: float = 1.0, bias: float = -1.0, weights: Weights = GIVEN, without: str = ""):
        """without: kinds of given words that count as any other: t(hreats), n(egations), r(eports), y (targets)."""
        self.words = {k: w for k, w in lexicon.items() if not k.endswith("*")}
        self.stems = {k[:-1]: w for k, w in lexicon.items() if k.endswith("*")}
        self.slope, self.bias = slope, bias
        self.weights, self.without = weights, without
        self.machine = composed(transducers(weights))
        self.cache: dict[str, str] = {}

    def symbol(self, word: str) -> str:
        x = self.cache.get(word)
        if x is None:
            x = self._symbol(word)
            if len(self.cache) >= 500_000:
                self.cache.clear()
            self.cache[word] = x
        return x

    def _symbol(self, word: str) -> str:
        for name, listed in (("t", THREATS), ("n", NEGATIONS), ("r", REPORTS), ("y", TARGETS)):
            if word in listed and name not in self.without:
                return name
        weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n)])
        return f"i{max(1, min(LEVELS, round(weight / LEVEL)))}" if weight > 0 else "o"

    def clause(self, tokens: list[str]) -> float:
        return weigh(self.machine, [self.symbol(t) for t in tokens])

    def loaded(self, text: str) -> Iterator[list[str]]:
        """The words of each clause that holds an insult or threat."""
        lowered = text.lower()
        hit = {w for w in set(_WORD.findall(lowered)) if self.symbol(w)[0] in "ti"}
        if hit:
            for part in _CLAUSE.split(lowered):
                tokens = _WORD.findall(part)
                if not hit.isdisjoint(tokens):
                    yield tokens

    def total(self, text: str) -> float:
        return sum(map(self.clause, self.loaded(text)), 0.0)

    def forms(self, text: str) -> list[float]:
        """For speech that is direct, reported, negated and both: sum of insults' levels, aimed insults, aimed threats, other threats."""
        out = [0.0] * 16
        for tokens in self.loaded(text):
            for symbol in read(self.machine, [self.symbol(t) for t in tokens]):
                reported, negated = symbol[0] == '"', "~" in symbol
                symbol = symbol.lstrip('"~')
                at = 4 * (reported + 2 * negated)
                if symbol[0] in "iI":
                    out[at] += LEVEL * int(symbol[1:])
                    out[at + 1] += symbol[0] == "I"
                elif symbol in "tT":
                    out[at + (2 if symbol == "T" else 3)] += 1
        return out

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(total) + self.bias))))


def _labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """text, toxic of the labelled training documents; contradicting labels count as toxic."""
    key = id_key(F.col("doc_id")).alias("_key")
    kept = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) != 0).where("toxic IS NOT NULL")
    kept = kept.groupBy(key).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    kept = kept.orderBy(mixed(F.col("_key"), 5), "_key").limit(limit)
    return saved(docs.select(key, F.col("text").cast("string").alias("text")).join(F.broadcast(kept), "_key").select("text", "toxic"))


def learned(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, without: str = "") -> Grammar:
    """The grammar with weights from labelled documents; without any, the given lists alone."""
    ship(docs.sparkSession)
    train = _labelled(docs, labels, limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column(0), batch.column(1)):
                (toxic if label.as_py() else other).update(features_of(text.as_py() or ""))
                (toxic if label.as_py() else other)[""] += 1
            keys = list(toxic | other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([other[k] for k in keys], pa.int64())],
                ["feature", "toxic", "other"],
            )

    counted = train.mapInArrow(count, "feature string, toxic bigint, other bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counted = saved(counted)
    sizes = (counted.where("feature = ''").select("toxic", "other").head()) or (0, 0)
    # at LEAST_TOXIC toxic documents and LEAST_ODDS times the rate of others; labelled texts are bounded, and with them this list
    odds = F.log((F.col("toxic") + 0.5) / (sizes[0] + 1)) - F.log((F.col("other") + 0.5) / (sizes[1] + 1))
    chosen = counted.where((F.col("feature") != "") & (F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") > F.col("other"))).select("feature", odds.alias("odds")).where(F.col("odds") > math.log(LEAST_ODDS))
    lexicon = {r["feature"]: r["odds"] / 4 for r in chosen.collect()}
    grammar = Grammar(lexicon, without=without)
    if not (sizes[0] and sizes[1]):
        return grammar

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(lexicon, without=without)
        for batch in batches:
            found = [own.forms(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["forms", "toxic"])

    # sixteen numbers for each of at most limit documents
    rows = train.mapInArrow(formed, "forms array<double>, toxic int").collect()
    forms, toxic = np.array([r["forms"] for r in rows]), np.array([r["toxic"] for r in rows])
    weights = weighed(forms, toxic)
    points = Counter()
    for x, t in zip(np.round(np.log1p(totals(forms, weights)), 1).tolist(), toxic.tolist()):
        points[x, t] += 1
    slope, bias = fitted([(x, points[x, 1], points[x, 0] + points[x, 1]) for x in sorted({x for x, _ in points})])
    return Grammar(lexicon, slope, bias, weights, without)


def totals(forms: np.ndarray, weights: Weights) -> np.ndarray:
    """Documents' weights from their forms."""
    left = np.repeat([1.0, weights.reported, weights.negated, weights.negated * weights.reported], 4)
    return forms @ (left * np.tile([1.0, weights.targeted, THREAT, weights.unaimed], 4))


def weighed(forms: np.ndarray, toxic: np.ndarray) -> Weights:
    """Arcs' weights: the given ones, but for those that labels speak against, one after another until none moves."""
    held = forms.any(axis=1)
    best, reached = GIVEN, _likelihood(np.log1p(totals(forms, GIVEN)), toxic)
    moved = bool(held.any())
    while moved:
        moved = False
        for name, values in TRIED.items():
            tried = [(_likelihood(np.log1p(totals(forms, best._replace(**{name: v}))), toxic), v) for v in values]
            top, v = max(tried)
            if top > reached + EVIDENCE:
                best, reached, moved = best._replace(**{name: v}), top, True
    return best


def _likelihood(x: np.ndarray, toxic: np.ndarray) -> float:
    """Log-likelihood of the logistic curve over x that fits best, with a small penalty, by Newton's steps."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    penalty = np.array([0.5, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (toxic - p) - penalty * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        beta = np.clip(beta + np.linalg.solve(curve, slope), -30, 30)
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ beta, -30, 30))), 1e-12, 1 - 1e-12)
    return float(np.where(toxic == 1, np.log(p), np.log(1 - p)).sum() - (penalty * beta**2).sum() / 2)


def fitted(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and bias of a logistic curve through (logarithm of 1 + total, toxic, all) counts, by gradient steps with a small penalty."""
    slope, bias = 1.0, -1.0
    whole = sum(n for _, _, n in points)
    for _ in range(3000):
        gs = gb = 0.0
        for x, t, n in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + bias))))
            gs += (n * p - t) * x
            gb += n * p - t
        slope -= 0.5 * (gs / whole + 0.001 * slope)
        bias -= 0.5 * gb / whole
    return max(slope, 0.1), bias


def scored(docs: DataFrame, labels: DataFrame, without: str = "") -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs. without: kinds of given words to leave out, as in Grammar.

    Null and empty texts score as a text without any match. Repeated rows score alike; other columns
    are not looked at. A null doc_id has the crc32 of nothing and is held out.
    """
    ship(docs.sparkSession)
    grammar = learned(docs, labels, without=without)
    lexicon = grammar.words | {f"{k}*": w for k, w in grammar.stems.items()}
    shipped = docs.sparkSession.sparkContext.broadcast((lexicon, grammar.slope, grammar.bias, grammar.weights, without))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*shipped.value)
        for batch in batches:
            points = [own.score(own.total(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(points, pa.float64()), pa.array([int(p >= 0.5) for p in points], pa.int32())], ["doc_id", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return out.select("doc_id", (remainder == 0).alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() over all documents and labels."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
