"""Ends of ways at crowded nodes: pairs against brute force, and a node of very many ends in a minute."""

import math
import random

from pyspark.sql import functions as F
from test_crowds import ended

from wayline.operators import network as N

WAYS = "id long, kind int, class int, oneway boolean, name string, refs array<string>, node0 string, node1 string, heading0 double, heading1 double"


def brute(ways):
    ends = [(w, e, w[6 + e], w[8 + e]) for w in ways if w[1] for e in (0, 1) if w[6 + e] is not None and w[8 + e] is not None]
    best = {}
    for a, e, at, h in ends:
        for b, f, there, g in ends:
            if at != there or a[0] == b[0] or a[1] != b[1]:
                continue
            bare = [not w[4] and not w[5] for w in (a, b)]
            level = (3 if set(a[5]) & set(b[5]) else None) if a[5] and b[5] else 2 if a[4] and a[4] == b[4] else None if a[2] != b[2] or not any(bare) else 1 if all(bare) else 0
            go = lambda x, i, y, j: (not x[3] or i == 1) and (not y[3] or j == 0)
            if level is None or not (go(a, e, b, f) or go(b, f, a, e)):
                continue
            off = math.fmod(abs(h + math.pi - g), 2 * math.pi)
            turn = min(off, 2 * math.pi - off)
            if turn <= math.radians(100 if level else 35):
                key = (at, a[0], e)
                best[key] = min(best.get(key, (9,)), (-level, turn, b[0], f))
    return sorted((i, e, x[2], x[3]) for (at, i, e), x in best.items() if best.get((at, x[2], x[3]), (0, 0, None, None))[2:] == (i, e))


def test_pairs_against_brute_force(spark):
    r = random.Random(5)
    for some, fine in ((1, 8), (3, 40), (2, 10**9)):
        ways = []
        for i in range(250):
            h = [r.randrange(fine) * 2 * math.pi / fine * r.choice((1, 1, -1)) for _ in (0, 1)]
            ways.append((i, r.choice((0, 1, 1, 1)), r.randrange(2), r.choice((True, False, False)), r.choice((None, "", "", "A", "B")), r.choice(([], [], [], ["1"], ["2", "1"])), *[r.choice([None, *map(str, range(some))]) for _ in (0, 1)], r.choice((None, h[0], h[0], h[0], h[0])), h[1]))
        got = sorted(map(tuple, N.pair_ends(spark.createDataFrame(ways, WAYS)).collect()))
        assert got == brute(ways) and len(got) > 20


def test_pairs_of_a_crowded_node(spark):
    # every way comes from the west to the node and has one opposite it that leaves to the east
    k = F.col("id")
    east = k % 2
    turn = F.floor(k / 2) * 1e-6
    w = spark.range(400_000).select("id", F.lit(1).alias("kind"), F.lit(0).alias("class"), F.lit(False).alias("oneway"), F.lit("").alias("name"), F.array().cast("array<string>").alias("refs"), F.lit(0).alias("node0"), F.lit(None).cast("int").alias("node1"), (turn + east * math.pi).alias("heading0"), F.lit(0.0).alias("heading1"))
    got = ended(spark, N.pair_ends(w).select(F.count("*"), F.sum((F.floor(k / 2) == F.floor(F.col("id2") / 2)).cast("int"))))
    assert tuple(got[0]) == (400_000, 400_000)


def test_roads_through_a_crowded_node(spark):
    # roads of three ways through two nodes that all roads share, told apart by their headings there
    road, part = F.floor(F.col("id") / 3), F.col("id") % 3
    turn = road * 1e-6
    node = lambda k: F.when(k.isin(1, 2), k)
    w = spark.range(300_000).select("id", F.lit(1).alias("kind"), F.lit(0).alias("class"), F.lit(False).alias("oneway"), F.lit("").alias("name"), F.array().cast("array<string>").alias("refs"), node(part).alias("node0"), node(part + 1).alias("node1"), turn.alias("heading0"), (turn + math.pi).alias("heading1"), (part + 1.0).alias("length"))
    x = N.chain_roads(w).groupBy((F.col("id") - F.col("road")).alias("part"), "road_length", "offset", "reverse").count()
    assert sorted(map(tuple, ended(spark, x))) == [(0, 6.0, 0.0, 0, 100_000), (1, 6.0, 1.0, 0, 100_000), (2, 6.0, 3.0, 0, 100_000)]
