"""Replacement in one pass against replacement in order; reachability by bitmaps against a search."""

import random
import time

from slatewise.functions.replacing import Replacer
from slatewise.operators import graph, patch


def in_order(text, plan):
    for old, new in plan:
        if old:
            text = text.replace(old, new)
    return text


def test_one_pass_is_the_order():
    """Small alphabets, so that olds touch, overlap, hold each other and are made by new texts."""
    rng = random.Random(2)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(rng.randint(0, n)))
    one_pass = 0
    for k in range(30_000):
        a = "ab" if k % 3 == 0 else "abcdefgh" if k % 3 == 1 else "abcdefghijklmnopqrstuvwxyz."
        plan = [(word(a, 4), word(a, 4)) for _ in range(rng.randint(0, 5))]
        text = word(a, 40)
        replacer = Replacer(plan)
        slow = replacer.one_by_one
        replacer.one_by_one = lambda t: slow(t) + "\0"  # noqa: B023
        got = replacer(text)
        one_pass += not got.endswith("\0") and got != text
        assert got.removesuffix("\0") == in_order(text, plan), (text, plan)
    assert one_pass > 1500


def references(n):
    names = [(f"image{i}.png", f"image{i}_repl.{('svg', 'pdf', 'webp')[i % 3]}") for i in range(n)]
    return [(w + old, w + new) for old, new in names for w in ("../media/", "ppt/media/")]


def test_a_thousand_replacements_of_a_large_part():
    plan = references(500)
    rng = random.Random(1)
    text = "".join(f'<Relationship Id="r{i}" Target="../media/image{rng.randint(0, 700)}.png"/>' for i in range(150_000))
    assert len(text) > 8_000_000
    replacer = Replacer(plan)
    replacer.one_by_one = None  # not needed
    began = time.process_time()
    got = replacer(text)
    assert time.process_time() - began < 5
    assert got == in_order(text, plan)


def test_rewrite(spark):
    rows = [("p", "a", 'x="../media/image1.png" y="ppt/media/image22.png"'), ("p", "b", None), ("q", "a", "../media/image1.png"), (None, "a", "../media/image1.png"), ("p", "c", "")]
    parts = spark.createDataFrame(rows, "package string, path string, xml string")
    plan = spark.createDataFrame([("p", 2, "image1.png", "image1_repl.svg"), ("p", 1, "image22.png", "image22_repl.jpg"), ("r", 1, "image1.png", "x.svg")], "package string, seq int, old_name string, new_name string")
    got = {(r.package, r.path): r.xml for r in patch.rewrite(parts, patch.references(plan)).collect()}
    assert got == {("p", "a"): 'x="../media/image1_repl.svg" y="ppt/media/image22_repl.jpg"', ("p", "b"): None, ("q", "a"): "../media/image1.png", (None, "a"): "../media/image1.png", ("p", "c"): ""}


def searched(roots, edges, blocked):
    out = set()
    following = {}
    for p, a, b in edges:
        following.setdefault((p, a), []).append(b)
    for p, slide, node in roots:
        todo = [node] if (p, node) not in blocked else []
        seen = set(todo)
        while todo:
            for b in following.get((p, todo.pop()), ()):
                if b not in seen and (p, b) not in blocked:
                    seen.add(b)
                    todo.append(b)
        out |= {(p, slide, n) for n in seen}
    return out


def test_reach_by_bits(spark):
    """Two packages, 300 slides and more, negative and large numbers of slides, cycles, blocked roots."""
    rng = random.Random(7)
    edges = [(rng.choice("pq"), rng.randint(0, 60), rng.randint(0, 60)) for _ in range(260)]
    roots = [("p", s, rng.randint(0, 60)) for s in range(300)] + [("q", s, rng.randint(0, 60)) for s in (-130, -1, 0, 63, 64, 1 << 40)] + [("p", 5, 3), ("p", 5, 3)]
    blocked = {("p", 3), ("q", 9), ("p", 20)}
    frames = spark.createDataFrame(roots, "package string, slide_no bigint, node int"), spark.createDataFrame(edges, "package string, src int, dst int"), spark.createDataFrame(sorted(blocked), "package string, node int")
    got = graph.reachable(*frames)
    assert got.columns == ["package", "slide_no", "node"] and got.schema["slide_no"].dataType.simpleString() == "bigint"
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == searched(roots, edges, blocked)
    sets = graph.reached_sets(*frames).cache()
    assert sets.select("package", "node", "word").distinct().count() < len(rows) / 15 and sets.count() < len(rows) / 3  # 300 slides are five words, each in parts
    assert graph.reachable(frames[0].limit(0), *frames[1:]).count() == 0
