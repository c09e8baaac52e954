"""The general problems' operators against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayline.functions.clean import mac_name, unix_millis, unix_seconds
from wayline.operators.gridding import clean_readings, empty_slots, regular_grid
from wayline.operators.hierarchy import descendants, edges, hierarchy
from wayline.operators.intervals import merge_intervals, periods_and_gaps
from wayline.operators.spatial import EARTH_M, position, region_of, within_distance


def brute_tops(parent):
    ids = set(parent) | {p for p in parent.values() if p}
    out = {}
    for i in ids:
        seen, x = [], i
        while parent.get(x) and x not in seen:
            seen.append(x)
            x = parent[x]
        out[i] = ("loop", min(seen[seen.index(x):])) if x in seen else ("tree", x, len(seen))
    return out


@pytest.mark.parametrize("last", [88, 200, 65_536])
def test_hierarchy_random(spark, last):
    rnd = random.Random(last)
    parent = {f"n{i:03d}": (f"n{rnd.randrange(i):03d}" if i and rnd.random() < 0.9 else None) for i in range(150)}
    parent |= {f"c{i}": f"c{(i + 1) % 5}" for i in range(5)} | {"self": "self", "t1": "c2", "t2": "t1", "t3": "t2", "ghosted": "nowhere"}
    parent |= {f"d{i:03d}": f"d{i - 1:03d}" if i else None for i in range(90)}
    want = brute_tops(parent)
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    got = {r.id: r for r in hierarchy(df, last=last).collect()}
    assert set(got) == set(want)
    size = {i: 0 for i in got}
    for i, w in want.items():
        r = got[i]
        assert r.top == w[1] and r.has_row == (i in parent)
        if w[0] == "tree":
            assert r.status == "tree" and r.depth == w[2] and r.path[0] == w[1] and r.path[-1] == i and len(r.path) == w[2] + 1
            for a in r.path:
                size[a] += 1
        else:
            assert r.path is None and r.depth is None
    assert got["c0"].status == "loop" and got["self"].status == "loop" and got["t3"].status == "into_loop"
    assert all(got[i].subtree_size == size[i] for i, w in want.items() if w[0] == "tree")
    assert [got[i].subtree_size for i in ("t1", "t2", "t3", "c0")] == [3, 2, 1, None]
    pairs = descendants(hierarchy(df, last=last), below_loops=False)
    assert pairs.count() == sum(w[2] for w in want.values() if w[0] == "tree")
    bare = {r.id: (r.top, r.depth, r.subtree_size, r.status) for r in hierarchy(df, paths=False, last=last).collect()}
    assert bare == {i: (r.top, r.depth, r.subtree_size, r.status) for i, r in got.items()}


def test_hierarchy_of_many_layers(spark, monkeypatch):
    from wayline.operators import hierarchy as H

    monkeypatch.setattr(H, "MERGED", 2)
    parent = {f"d{i:02d}": f"d{i - 1:02d}" if i else None for i in range(9)} | {"x": "d03", "loop": "loop", "y": "loop"}
    got = {r.id: (r.top, r.depth, r.subtree_size) for r in hierarchy(spark.createDataFrame(list(parent.items()), "id string, parent string"), last=1).collect()}
    assert got == {f"d{i:02d}": ("d00", i, 9 - i + (i <= 3)) for i in range(9)} | {"x": ("d00", 4, 1), "loop": ("loop", None, None), "y": ("loop", None, 1)}


def test_hierarchy_peeled_to_the_cycles(spark):
    parent = {"top": None, "u1": "top", "u2": "u1", "u3": "u1", "a": "b", "b": "c", "c": "a", "self": "self", "t1": "c", "t2": "t1", "g": "ghost"}
    want = brute_tops(parent)
    for last in (0, 2, 100):
        got = {r.id: r for r in hierarchy(spark.createDataFrame(list(parent.items()), "id string, parent string"), last=last).collect()}
        assert {i: r.top for i, r in got.items()} == {i: w[1] for i, w in want.items()}
        assert {i for i, r in got.items() if r.status == "loop"} == {"a", "b", "c", "self"} and got["t2"].below == ["t1", "t2"] and got["u3"].path == ["top", "u1", "u3"]


def test_hierarchy_edges_dirt(spark):
    rows = [("a", None, 1), ("a", "r", 2), ("a", "r", 2), ("b", "", 3), (None, "a", 4), ("", "a", 5)]
    got = {r.id: r.parent for r in edges(spark.createDataFrame(rows, "id string, parent string, size int"), "id", "parent").collect()}
    assert got == {"a": "r", "b": None}
    none = spark.createDataFrame([], "id string, parent string")
    assert hierarchy(edges(none, "id", "parent")).count() == 0


def test_clean(spark):
    rows = [(" Quern.LOCAL ", 1767598000.123), ("\tquern", 1767598000123.0), ("", float("nan")), (None, None)]
    df = spark.createDataFrame(rows, "mac string, t double")
    got = df.select(mac_name(F.col("mac")), unix_seconds(F.col("t")), unix_millis(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("quern", 1767598000.123, 1767598000123)] * 2 + [(None, None, None)] * 2


def test_grid(spark):
    rows = [("a", 0.0, 1.0, None), ("a", 0.0, 1.0, 5.0), ("a", 30.0, 2.0, float("nan")), ("a", 400.0, 9.0, 7.0), ("a", 2500.0, 3.0, 1.0), ("b", 60.0, 2000.0, None), (None, 5.0, 1.0, 1.0), ("a", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double, load double, mem double").withColumn("slot", F.lit(1)).withColumn("w", F.lit(2))
    fields = {"load": (0, 1000), "mem": (0, 100)}
    grid = regular_grid(clean_readings(df, df["k"], df["t"], fields), list(fields))
    g = {r.slot: r for r in grid.collect()}
    assert set(g) == {0, 1, 2, 3, 4, 5, 6, 41}  # 400 to 2500 is more than 1800
    assert g[0].load_n == 2 and g[0].mem_n == 1 and g[0].load_mark == "measured"
    assert g[3].load_mark == "missing" and g[3].load is None
    assert 1 <= g[0].load <= 2
    assert {(r.slot, r.field) for r in empty_slots(grid, list(fields)).collect()} == {(s, f) for s in range(1, 6) for f in fields}
    assert regular_grid(clean_readings(df.limit(0), df["k"], df["t"], fields), list(fields)).count() == 0


def test_grid_follows_a_line(spark):
    rows = [("a", float(t), 2.0 + t / 600.0) for t in range(0, 1800, 37)]
    df = spark.createDataFrame(rows, "mac string, t double, v double")
    for r in regular_grid(clean_readings(df, df["mac"], df["t"], {"v": (0, 1e9)}), ["v"]).collect():
        assert math.isclose(r.v, 2.0 + r.t / 600.0, abs_tol=1e-9)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_intervals_random(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["a", "b", "hot", "hot", "hot"]), (s := rnd.randrange(2000)), s + rnd.choice([0, 1, 5, 30, 200])) for _ in range(300)]
    rows += [("a", 5, 4), (None, 1, 2), ("a", None, 2), ("a", 1, None), ("z", 7, 7), ("z", 7, 7)]
    want = set()
    for k in {r[0] for r in rows if r[0]}:
        iv = sorted((s, e) for a, s, e in rows if a == k and s is not None and e is not None and e >= s)
        cur, last = None, None
        for s, e in iv:
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
                continue
            if cur:
                want.add((k, "busy", *cur))
                last = cur[1]
            if last is not None and s - last <= 40:
                want.add((k, "gap", last, s))
            cur = [s, e]
        if cur:
            want.add((k, "busy", *cur))
    df = spark.createDataFrame(rows, "s string, k int, e int")  # names that clash with the operator's own
    got = [tuple(r) for r in periods_and_gaps(df, "s", "k", "e", 40, parts).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r.n for r in merge_intervals(df, "s", "k", "e", parts).collect()) == sum(1 for a, s, e in rows if a and s is not None and e is not None and e >= s)
    assert merge_intervals(df.limit(0), "s", "k", "e", parts).count() == 0


def test_points_everywhere(spark):
    rnd = random.Random(5)
    spots = [(rnd.uniform(-180, 180), rnd.choice([90, -90, 89.999, 89.9, -89.99, 60, 0, 45]) + rnd.uniform(-0.01, 0)) for _ in range(60)]
    a = [(f"a{i}", x, max(-90.0, min(90.0, y))) for i, (x, y) in enumerate(spots)] + [("edge", 179.9999, 10.0), ("pole", 0.0, 90.0), ("none", 0.0, 0.0), ("nan", float("nan"), 1.0), (None, 1.0, 1.0)]
    b = [(i, x + rnd.uniform(-0.05, 0.05), y + rnd.uniform(-0.01, 0.01)) for i, (_, x, y) in enumerate(a) if x == x] + [(900, -179.9999, 10.0), (901, 180.5, 10.0), (902, 120.0, 89.9995), (903, 5.0, 90.5), (904, None, 1.0)]
    b += b[:5]
    A, B = (spark.createDataFrame(r, f"id {t}, lon double, lat double").select("id", position(F.col("lon"), F.col("lat")).alias("pos")) for r, t in ((a, "string"), (b, "long")))

    def dist(p, q):
        (x1, y1), (x2, y2) = (tuple(map(math.radians, v)) for v in (p, q))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * EARTH_M * math.asin(min(1, math.sqrt(h)))

    ok = lambda x, y: x is not None and x == x and abs(y) <= 90 and (x, y) != (0, 0)
    for radius in (300.0, 3000.0, 60_000.0):
        want = {(i, j) for i, x, y in a if i and ok(x, y) for j, u, v in b if ok(u, v) and dist((x, y), (u, v)) <= radius}
        got = [(r.a_id, r.b_id) for r in within_distance(A, B, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert within_distance(A.limit(0), B, 300.0).count() == 0


def test_regions(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    r = spark.createDataFrame([("m", [dict(lon=x, lat=y) for x, y in ring]), ("thin", []), (None, None)], "region string, ring array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 9.0, 9.0), (4, None, 1.0), (1, 1.0, 1.0)], "id int, lon double, lat double").select("id", position(F.col("lon"), F.col("lat")).alias("pos"))
    assert [tuple(x) for x in region_of(p, r).collect()] == [(1, "m")]
