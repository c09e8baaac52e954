"""Frequent words as purged blocks, ties, and scores refined until stable."""

import random

from wayline.llm import linkage
from wayline.llm.linkage import _best, _refine, fold, link
from wayline.llm.lookalike import skeleton

SCHEMA = "names array<string>, regions array<string>, near array<string>, places array<string>, year int, marks array<string>"


def test_records_of_a_purged_word_meet_by_a_second_key(spark, monkeypatch):
    rnd = random.Random(3)
    core = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)) + "x"
    a = [(f"a{i}", [f"Zemphyr {core()}"] if i % 2 else ["Zemphyr Hall"], [f"R{i}"], [], [], None, []) for i in range(6)] + [(f"x{i}", [f"{core()} Hall"], ["R1"], [], [], None, []) for i in range(40)]
    b = [(f"b{i}", n, r, [], [], None, []) for i, (_, n, r, *_x) in enumerate(a)]
    df = lambda rows: spark.createDataFrame(rows, f"id string, {SCHEMA}")
    whole = {(r.a, r.b) for r in link(df(a), df(b)).collect()}
    monkeypatch.setattr(linkage, "BUDGET", 4)
    assert {(r.a, r.b) for r in link(df(a), df(b)).collect()} == whole and len(whole) == 46


def test_ties_go_to_the_smaller_id(spark):
    rows = [("a", "q9", 5.0, 5.0), ("a", "q10", 5.0, 5.0), ("a", "q11", 4.0, 5.0), ("b", "q1", 1.0, 2.0)]
    got = _best(spark.createDataFrame(rows, "a string, b string, own double, score double")).collect()
    assert [(r.a, r.b) for r in got] == [("a", "q10")]


def test_refined_until_stable(spark):
    rnd = random.Random(5)
    scored = [(f"a{i}", f"b{j}", float(rnd.randrange(-3, 9))) for i in range(12) for j in range(3)]
    keys = [(f"a{i}", i % 4) for i in range(12)] + [(f"a{i}", 10 + i % 3) for i in range(6)]
    own = {(a, b): o for a, b, o in scored}
    now = dict(own)
    for _ in range(40):
        new = {}
        for a, b in own:
            means = []
            for x, k in keys:
                if x == a:
                    others = [now[(y, b)] for y, m in keys if m == k and y != a]
                    if others:
                        means.append(sum(others) / len(others))
            new[(a, b)] = own[(a, b)] + linkage.SPREAD * max(max(means, default=0.0), 0.0)
        now = new
    got = _refine(spark.createDataFrame(scored, "a string, b string, own double"), spark.createDataFrame(keys, "a string, key long"))
    for r in got.collect():
        assert abs(r.score - now[(r.a, r.b)]) < 2e-3
    assert got.count() == len(scored)


def test_plain_text_is_folded_the_same_way():
    import unicodedata

    for s in ("Plain  Name ", " A b", "x", "", "St. Ann (Bay) / No. 9"):
        x = unicodedata.normalize("NFD", skeleton(s)).lower().strip()
        assert fold(s) == " ".join(x.split())
