"""The draw for counts of any size, and quotas that are reached to the smallest record."""

import random

import numpy as np
import pytest

from wayline.llm import mixing, packing, tokens


def test_large_draws_have_the_right_mean_and_spread():
    rng = np.random.Generator(np.random.PCG64(5))
    good, bad, n = 6_000_000_000, 14_000_000_000, 5_000_000_000
    x = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(3000)], float)
    total, p = good + bad, good / (good + bad)
    sd = (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5
    assert abs(x.mean() - n * p) < 5 * sd / 3000**0.5 and abs(x.std() / sd - 1) < 0.08


def test_the_recursion_draws_as_the_generator_does(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(6))
    want = rng.hypergeometric(40, 25, 30, 20_000)
    monkeypatch.setattr(mixing, "GENERATOR_LIMIT", 3)
    got = np.array([mixing.hypergeometric(rng, 40, 25, 30) for _ in range(20_000)])
    a, b = np.bincount(want, minlength=41) / 20_000, np.bincount(got, minlength=41) / 20_000
    assert np.abs(a - b).max() < 0.02 and got.min() >= 5 and got.max() <= 30
    assert [mixing.hypergeometric(rng, g, b, n) for g, b, n in ((9, 0, 4), (0, 9, 4), (5, 5, 10), (5, 5, 0))] == [4, 0, 5, 0]


def test_shares_are_drawn_whole():
    have = np.array([3, 0, 5_000_000_000, 7])
    got = mixing.draw_shares(np.random.Generator(np.random.PCG64(1)), have, 2_000_000_000)
    assert got.sum() == 2_000_000_000 and (got <= have).all() and (got >= 0).all()


def test_closing_sizes():
    assert mixing.closing_sizes(100.5, [60, 30, 7, 200], [1, 5, 1, 9]) == [(60, 1), (30, 1), (7, 1)]
    assert mixing.closing_sizes(5.0, [6], [3]) == []


def test_a_long_record_at_the_edge_does_not_end_the_draw(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(["word"] * (900 if i % 4 == 0 else rnd.randrange(1, 40))), "a" if i < 200 else "b") for i in range(260)]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    m = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1)], "source string, weight double, max_repeats int")
    got = mixing.mix(df, m, "id", "text", "source").toPandas()
    size = {i: len(tokens.encode(t)) for i, t, _ in rows}
    quota = min(sum(size[i] for i, _, s in rows if s == x) for x in "ab")
    have = got.groupby("source")["n_tokens"].sum()
    for s in "ab":
        free = [size[i] for i, _, x in rows if x == s and i not in set(got["id"])]
        assert have[s] <= quota and (not free or quota - have[s] < min(free))
    assert not got.duplicated(["id", "pass"]).any()


def test_too_many_kinds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_CONTAINERS", 1)
    boxes = spark.createDataFrame([("s", 64), ("l", 2048)], "container string, capacity int")
    docs = spark.createDataFrame([(1, "x", "en")], "id long, text string, lang string")
    with pytest.raises(ValueError):
        packing.pack(docs, boxes, "id", "text", "lang")
