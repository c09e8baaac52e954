"""Operators along series, cut into chunks: the same rows whatever the chunk; null positions, ties and empty tables."""

import random

from pyspark.sql import functions as F

from wayline.operators import sequences as Q


def _rows(n=250):
    rnd = random.Random(2)
    rows, at = [], 0
    for i in range(n):
        at += rnd.choice([0, 1, 2, 30, 700])
        rows.append(("hot" if i % 3 else "b", at, round(rnd.uniform(0, 50), 2) if rnd.random() < 0.8 else None, i, rnd.choice("xy")))
    return rows + [("hot", None, 5.0, 9000, "x"), (None, 40, 5.0, 9001, "x")]


SCHEMA = "road string, off long, v double, n int, attr string"


def test_any_chunk_gives_the_same(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    runs = {
        "fill": lambda c: Q.fill_gaps(df, ["road"], "off", "v", "n", c),
        "grade": lambda c: Q.neighbour_grade(df.where("v is not null"), ["road"], "off", "v", "n", c),
        "around": lambda c: Q.around(df, ["road"], "off", 40, c, t=F.sum("v"), k=F.count("*")),
        "despike": lambda c: Q.despike(df, ["road"], "off", "v", 40, chunk=c),
        "smooth": lambda c: Q.smooth(df, ["road"], "off", "v", 10.0, chunk=c).withColumn("smooth", F.round("smooth", 9)),
        "profile": lambda c: Q.profile(df.where("off is not null and v is not null and road is not null"), ["road"], "off", 1.0, "v", "n", c).withColumn("distance", F.round("distance", 6)),
        "bins": lambda c: Q.summary_bins(df.where("road is not null"), ["road"], "off", "v", F.col("attr"), 60.0, "n", c).withColumn("mean", F.round("mean", 9)),
        "contiguous": lambda c: Q.contiguous(df.where("off is not null and road is not null").withColumn("to", F.col("off") + 1), ["road"], "off", "to", "n", c),
    }
    for name, run in runs.items():
        many, few = ({tuple(sorted(r.asDict().items(), key=str)) for r in run(c).collect()} for c in (50, 1_000_000))
        assert many == few and many, name


def test_bins_by_hand(spark):
    rows = sorted((o, n, s, a) for k, o, s, n, a in _rows() if k == "hot" and o is not None and s is not None)
    want, now = [], None
    for o, n, s, a in rows:
        if now and now[1] == a and o - now[0] < 60:
            now[2], now[3], now[4] = o, now[3] + 1, now[4] + s
        else:
            now = [o, a, o, 1, s]
            want.append(now)
    df = spark.createDataFrame(_rows(), SCHEMA).where("road = 'hot'")
    got = sorted((r.bin, r.off, r.length, r.n, round(r["mean"], 6)) for r in Q.summary_bins(df, ["road"], "off", "v", F.col("attr"), 60.0, "n", 100).collect())
    assert got == [(i, o, to - o, n, round(t / n, 6)) for i, (o, _, to, n, t) in enumerate(want)]
    assert Q.summary_bins(df.limit(0), ["road"], "off", "v", F.col("attr"), 60.0, "n").count() == 0


def test_cyclic_runs(spark):
    df = spark.createDataFrame([("a", d) for d in (1, 2, 6, 7, 4)] + [("all", d) for d in range(1, 8)] + [("one", 7), ("one", 7), ("bad", 0), ("bad", None)], "k string, d int")
    got = sorted((r.k, r.start, r.stop, r.n) for r in Q.cyclic_runs(df, ["k"], "d", 1, 7).collect())
    assert got == [("a", 4, 4, 1), ("a", 6, 2, 4), ("all", 1, 7, 7), ("one", 7, 7, 1)]
    assert Q.cyclic_runs(df.limit(0), ["k"], "d", 1, 7).count() == 0
