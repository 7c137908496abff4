"""The toxicity grammar: each transducer and their composition against loops, and pairs of clauses that differ in one word."""

import itertools
import random

import pytest
from conftest import SF

from slatewise.llm import toxicity as T

SYMBOLS = [*T.PLAIN, "t", *T.INSULTS]


def outputs(machine, symbols):
    """(symbols out, weight) of every accepted path, by trying all."""
    paths = [(s, [], 0.0) for s in machine.starts]
    for x in symbols:
        paths = [(to, [*out, y], w + v) for s, out, w in paths for y, v, to in machine.arcs(s, x)]
    return [(out, w) for s, out, w in paths if machine.accepts(s)]


def rules(symbols, weights=T.GIVEN):
    """A clause's weight by the rules as they are told, with loops over all words."""
    near = lambda i, x, before, after: any(symbols[j] == x for j in range(max(0, i - before), min(len(symbols), i + after + 1)) if j != i)
    total = 0.0
    for i, x in enumerate(symbols):
        if x == "t":
            w = T.THREAT if near(i, "y", T.NEAR, T.NEAR) else weights.unaimed
        elif x[0] == "i":
            level = int(x[1:])
            if any(y[0] == "i" for y in symbols[max(0, i - T.NEAR) : i]):
                level = min(level + 1, T.LEVELS)
            w = T.LEVEL * level + (weights.targeted if near(i, "y", T.NEAR, T.NEAR) else 0)
        else:
            continue
        total += w * (weights.negated if near(i, "n", T.NEAR, 0) else 1) * (weights.reported if "r" in symbols else 1)
    return total


def test_composition_is_one_after_another_and_follows_the_rules():
    random.seed(1)
    parts, machine = T.transducers(), T.composed(T.transducers())
    clauses = [[random.choice(SYMBOLS[:6] + ["o", "o", "y", "t", "i2"]) for _ in range(random.randrange(0, 12))] for _ in range(400)]
    clauses += [list(c) for c in itertools.product(["o", "y", "n", "r", "t", "i1"], repeat=3)]
    for clause in clauses:
        chained = [(clause, 0.0)]
        for p in parts:
            chained = [(out, w + v) for symbols, w in chained for out, v in outputs(p, symbols)]
        found = outputs(machine, clause)
        assert len(chained) == len(found) == 1
        assert found[0][0] == chained[0][0] and found[0][1] == pytest.approx(chained[0][1]) == pytest.approx(T.weigh(machine, clause))
        assert found[0][1] == pytest.approx(rules(clause))


def test_negation_and_report_reach_threats():
    g = T.Grammar({"moron": 1.0})
    assert g.total("I will hurt you") == T.THREAT == g.total("You I will hurt")
    assert g.total("I will hurt") == T.UNAIMED
    assert g.total("I will not hurt you") == pytest.approx(T.NEGATED * T.THREAT)
    assert g.total("He said that I will hurt you") == pytest.approx(T.REPORTED * T.THREAT)
    assert g.total("you moron, she said") == pytest.approx(T.REPORTED * g.total("you moron, she cried"))


def test_pairs_change_the_verdict(spark):
    """Clean documents hold the same threats, negated or reported: one word changes what is predicted."""
    names = [f"word{i}" for i in range(30)]
    rows, labels = [], []
    for i in range(120):
        a = names[i % 30]
        for k, (text, toxic) in enumerate(((f"I will kill you {a}.", 1), (f"I will never kill you {a}.", 0), (f"The paper said I kill you {a}.", 0), (f"A calm {a}.", 0))):
            rows.append((4 * i + k, text))
            labels.append((4 * i + k, toxic))
    got = T.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    want = dict(labels)
    assert all(r.predicted == want[r.doc_id] for r in got)
    g = T.Grammar({})
    assert g.total("I will kill you") > g.total("I will never kill you") > 0


def test_lists_change_scores(spark, monkeypatch):
    """Without targets, negations, reports and threats the held-out scores are others."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    grammar = T.learned(docs, labels)
    texts = [r.text for r in docs.collect()]
    whole = [grammar.total(t or "") for t in texts]
    for name in ("TARGETS", "NEGATIONS", "REPORTS", "THREATS"):
        monkeypatch.setattr(T, name, frozenset())
    bare = T.Grammar(grammar.words | {f"{k}*": w for k, w in grammar.stems.items()})
    changed = sum(a != b for a, b in zip(whole, (bare.total(t or "") for t in texts)))
    assert changed > 0


def test_hard_texts(spark):
    rows = [(None, None), (1, ""), (2, "x " * 50_000), (3, "kill you " * 2000), (3, "kill you " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in T.scored(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()}
    assert got[None].held_out and got[None].score == got[1].score == got[2].score < 0.5 < got[3].score and got[3].predicted == 1


def test_other_weights_follow_the_rules_and_forms_give_totals():
    rng = random.Random(8)
    words = {"o": "calm", "y": "you", "n": "not", "r": "said", "t": "kill", "i1": "dolt", "i3": "moron"}
    for weights in (T.Weights(), T.Weights(2.0, 0.2, 0.8, 0.25), T.Weights(0.0, 1.0, 0.0, 1.0)):
        machine = T.composed(T.transducers(weights))
        g = T.Grammar({"dolt": 0.25, "moron": 0.75}, weights=weights)
        for _ in range(300):
            clauses = [[rng.choice(list(words)) for _ in range(rng.randint(0, 10))] for _ in range(2)]
            assert all(T.weigh(machine, c) == pytest.approx(rules(c, weights)) for c in clauses)
            text = ". ".join(" ".join(words[x] for x in c) for c in clauses)
            assert g.total(text) == pytest.approx(sum(rules(c, weights) for c in clauses))
            import numpy as np

            assert T.totals(np.array([g.forms(text)]), weights)[0] == pytest.approx(g.total(text))


def test_weights_are_learned(spark):
    """Reports that are as toxic as direct speech, negations that aren't at all: both weights follow the labels, the others stay."""
    texts = [("they kill you {}", 1), ("the paper said they kill you {}", 1), ("they never kill you {}", 0), ("a calm number {}", 0)]
    rows = [(4 * i + k, t.format(i), y) for i in range(150) for k, (t, y) in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    import numpy as np

    g = T.Grammar({})
    weights = T.weighed(np.array([g.forms(r[1]) for r in rows]), np.array([r[2] for r in rows]))
    assert weights.negated < T.NEGATED and weights.reported >= T.REPORTED and weights.unaimed == T.UNAIMED
    got = {r.doc_id: r.predicted for r in T.scored(docs, labels).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 0.95 * len(rows)
    assert T.weighed(np.zeros((10, 16)), np.array([0, 1] * 5)) == T.GIVEN


@pytest.mark.parametrize("without", ["t", "n", "r", "y", "tnry"])
def test_each_transducer_counts(spark, without):
    """Clauses whose label one kind of word decides are told apart; without negations, which no learned word can replace, they aren't."""
    texts = {
        "t": [("they will kill you {}", 1), ("they will greet you {}", 0)],
        "n": [("they will kill you {}", 1), ("they will never kill you {}", 0)],
        "r": [("they will kill you {}", 1), ("they said kill you {}", 0)],
        "y": [("they will kill you {}", 1), ("the scenes kill a whole evening {}", 0)],
    }
    pairs = [x for k in without for x in texts[k]]
    rows = [(len(pairs) * i + k, t.format("abcdefghijklmnopqrstuvwxyz"[i % 26] * 3), y) for i in range(60) for k, (t, y) in enumerate(pairs)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    want = {r[0]: r[2] for r in rows}
    right = [sum(r.predicted == want[r.doc_id] for r in T.scored(docs, labels, without=w).collect()) for w in ("", without)]
    assert right[0] == len(rows) and (right[1] < right[0] if "n" in without else right[1] <= right[0])
