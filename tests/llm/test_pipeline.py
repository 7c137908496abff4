import collections

import pytest
from conftest import SF

import corpus_pipeline
from slatewise.llm import bpe, line_dedup, mixing, ngram_join, quality
from slatewise.llm.common import saved

# columns whose names operators use themselves
SCHEMA = """doc_id bigint, text string, lang string, source string, n_chars bigint, _key int, n_lines string, n_removed int, _join_key string, _mix_n int, _row int, `row` string,
uid string, `key` string, component string, least string, copies string, stratum string, kept string, score string, size string, own string, _text_hash string, _removed string"""
N = 24
WORDS = " ".join(f"word{i}" for i in range(40))
LINES = "\n".join(f"this is line {i} of a text that is here more than once" for i in range(6))


def row(i, text, source, mark):
    return (i, text, "en", source, None if text is None else len(text), mark, *[None if k % 5 == 2 else mark if k in (1, 3, 4) else str(mark) for k in range(N - 6)])


@pytest.fixture(scope="module")
def rows():
    texts = [
        (None, "alpha " + WORDS, None), (None, "beta one two three four five six seven eight nine ten", "s"), (None, "gamma eins zwei drei vier", "\0"), (None, None, "s"), (None, "", None),
        (1, WORDS, "s"), (1, "another text under the same id with words of its own entirely", "s"), (2, WORDS, "t"), (2, WORDS, "t"), (3, WORDS + " more", None),
        (4, LINES, "s"), (5, LINES, "t"), (6, "own line first\n" + LINES, "s"), (7, "", "s"), (8, " \n ", "s"), (9, None, "u"), (10, "one", "u"), (11, "one", "u"), (12, "w " * 20_000, "s"),
    ]
    return [row(i, t, s, n) for n, (i, t, s) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def marks(df):
    return sorted(r["_key"] for r in df.collect())


def untouched(got, rows, but=()):
    """Every row that came out has the columns that it went in with."""
    names = [c.strip().split()[0].strip("`") for c in SCHEMA.split(",")]
    by = {r[5]: dict(zip(names, r)) for r in rows}
    for r in got.collect():
        assert all(r[c] == by[r["_key"]][c] for c in names if c not in but)


def test_quality_stage(spark, docs, rows):
    out = quality.kept_documents(docs, spark.read.parquet(f"{SF}/labels.parquet").limit(0))
    assert out.columns == docs.columns
    untouched(out, rows)
    # without trusted documents the base rules decide: 20 words, few of them repeated
    assert marks(out) == [0, 5, 7, 8, 9]


def test_line_stage(docs, rows):
    out = line_dedup.kept_documents(docs)
    assert out.columns == docs.columns
    untouched(out, rows, ("text", "n_chars"))
    assert marks(out) == [n for n in range(len(rows)) if rows[n][0] != 5]  # 5 is lines of 4 and nothing else
    got = {r["_key"]: r for r in out.collect()}
    assert got[12].text == "own line first" and got[12].n_chars == 14 and got[10].text == LINES and got[3].text is None and got[4].text == ""


def test_ngram_stage(docs, rows):
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    untouched(out, rows)
    # linked: 0, 5, 7, 8 and 9; 10, 11 and 12; 16 and 17 ("one")
    assert marks(out) == [0, 1, 2, 3, 4, 6, 10, 13, 14, 15, 16, 18]


def test_mixing_stage(docs, rows):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    untouched(out, rows)
    want = {r["_key"]: r.copies for r in mixing._mixed(docs.selectExpr("doc_id", "source", "cast(size(filter(split(coalesce(text, ''), '[ \n]'), x -> x <> '')) as bigint) size", "_key"), 3.0, mixing.SEED).collect()}
    assert collections.Counter(marks(out)) == +collections.Counter(want)
    assert {r[3] for r in rows if want[r[5]]} >= {"s", "t"}


def test_mixing_takes_near_targets_with_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 10, "a", n) for n in range(4)] + [(2, "w " * 10, "b", 9)], "doc_id bigint, text string, source string, n int")
    sizes, taken = collections.Counter(), collections.Counter()
    for r in mixing.mix(docs).collect():
        sizes[r.source], taken[r.source] = r.target, taken[r.source] + r.size * r.copies
    assert all(abs(sizes[s] - taken[s]) <= 10 for s in sizes)
    assert mixing.mixed_documents(docs).where("source = 'a'").count() * 10 == taken["a"]


def filled(sizes, weights, most=3.0):
    """Water-filling as a loop: clamp, share the excess by weight, until none is above."""
    target, open_ = {}, set(sizes)
    budget = float(sum(sizes.values()))
    while open_:
        whole = sum(weights[s] for s in open_)
        share = {s: budget * weights[s] / whole for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = most * sizes[s]
            budget -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [{"a": 20, "b": 20, "c": 960}, {f"s{i:02}": (i * 37) % 101 + i**3 for i in range(30)}, {"a": 5}, {"a": 1, "b": 1, "c": 1, "d": 1000, "e": 3}])
def test_targets_are_those_of_the_loop(spark, sizes):
    sized = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    weights = {s: n % 3 + 1 for n, s in enumerate(sorted(sizes))}
    want = filled(sizes, weights)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_stages_on_hard_rows_and_none(spark, docs, rows):
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = saved(stage(spark, now, SF))
            assert name == "bpe" or now.columns == docs.columns, name
        assert now.count() <= 3 * len(rows)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, SF))
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "line_dedup":
            assert docs.where("length(trim(text)) = 0").count() == 0
            own = {r.doc_id: r for r in line_dedup.dedup_lines(before).collect()}
            gone = {i for i, r in own.items() if r.n_removed and not r.text.strip()}
            assert {r.doc_id: r.text for r in docs.collect()} == {i: r.text for i, r in own.items() if i not in gone}
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    copies = collections.Counter({r.doc_id: r.copies for r in mixing.mix(before).collect()})
    assert collections.Counter(r.doc_id for r in docs.select("doc_id").collect()) == +copies
    own = bpe.Bpe(open(bpe.public_vocabulary(), encoding="utf-8").read())
    text = {r.doc_id: r.text for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == counts[-1]
    assert all(r.ids == own.encode(text[r.doc_id] or "") for r in last)
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in last)
