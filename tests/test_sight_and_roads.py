"""Views against a line of sight walked point by point, roads against a walk over the pairs, routes with turns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.operators import network as N


def _by_hand(h, canopy, x, y, cell, eye_m, radius, rays):
    eye = float(G.bilinear(h, np.array([x]), np.array([y]))[0]) + eye_m
    looked, seen = set(), set()
    for k in range(rays):
        best, i = -math.inf, 0
        while (d := cell * (0.5 + 0.7 * i)) <= radius:
            i += 1
            px, py = x + math.sin(2 * math.pi * k / rays) * d / cell, y - math.cos(2 * math.pi * k / rays) * d / cell
            c, r = math.floor(px), math.floor(py)
            if not (0 <= c < h.shape[1] and 0 <= r < h.shape[0]):
                break
            top = float(G.bilinear(h, np.array([px]), np.array([py]))[0]) if d < 3 * cell else h[r, c]
            if canopy is not None and d >= 60:
                top += canopy[r, c]
            angle = (top - eye - d * d / (2 * G.SIGHT_RADIUS)) / d
            near = math.hypot(c + 0.5 - x, r + 0.5 - y) * cell <= radius
            if near:
                looked.add((r, c))
            if angle >= best:
                best = angle
                if near:
                    seen.add((r, c))
    return looked, seen


@pytest.mark.parametrize("trees", [False, True])
def test_view_against_walked_lines(trees):
    rng = np.random.default_rng(4)
    h = rng.integers(0, 60, (31, 45)).astype(float)
    canopy = rng.integers(0, 20, h.shape).astype(float) if trees else None
    looked, seen = _by_hand(h, canopy, 20.3, 11.8, 30.0, 2.0, 520.0, 180)
    got = G.viewshed(h, canopy, h < 20, 20.3, 11.8, 30.0, 2.0, 520.0, 180, at_once=50)
    assert got["visible_km2"] == pytest.approx(len(seen) * 900 / 1e6)
    assert got["visible_share"] == pytest.approx(len(seen) / len(looked))
    assert got["water_km2"] == pytest.approx(sum(h[c] < 20 for c in seen) * 900 / 1e6)


def test_view_from_outside_and_nowhere():
    h = np.zeros((5, 5))
    assert G.viewshed(h, None, None, 2.5, 2.5, 10.0, 2.0, 1.0, 8)["visible_km2"] == 0.0
    assert G.viewshed(h, None, None, -9.0, 2.5, 10.0, 2.0, 20.0, 8)["visible_share"] == 0.0


WAYS = "id long, kind int, class int, oneway boolean, name string, refs array<string>, node0 string, node1 string, heading0 double, heading1 double, length double"


def _walk(pairs, length):
    """Roads of pairs {(id, end): (id2, end2)}, one way at a time."""
    out = {}
    for i in length:
        reach = {}
        for e in (0, 1):
            w, x, far, low, ring = i, e, 0.0, i, False
            while (w, x) in pairs:
                w, back = pairs[(w, x)]
                x = 1 - back
                if w == i:
                    ring = True
                    break
                far += length[w]
                low = min(low, w)
            reach[e] = (w, far, low, ring)
        if reach[0][3]:
            m = reach[0][2]
            w, x, far = m, 1, 0.0
            while w != i:
                far += length[w]
                w, back = pairs[(w, x)]
                x = 1 - back
            out[i] = (m, sum_ring(pairs, length, m), far, 1 - x)
        else:
            start = 0 if reach[0][0] <= reach[1][0] else 1
            out[i] = (min(reach[0][2], reach[1][2]), length[i] + reach[0][1] + reach[1][1], reach[start][1], start)
    return out


def sum_ring(pairs, length, m):
    w, x, total = m, 1, 0.0
    while True:
        total += length[w]
        w, back = pairs[(w, x)]
        x = 1 - back
        if w == m:
            return total


def test_roads_of_random_chains_and_rings(spark):
    rnd = random.Random(11)
    ids = rnd.sample(range(1, 10_000), 160)
    rows, at, node = [], 0, 0
    while at < len(ids):
        n = min(rnd.choice([1, 2, 3, 9, 40]), len(ids) - at)
        ring = n > 2 and rnd.random() < 0.5
        first = node
        for k in range(n):
            a, b = node, first if ring and k == n - 1 else node + 1
            turned = rnd.random() < 0.5
            rows.append((ids[at + k], 2, 1, False, f"R{first}", [], f"n{b if turned else a}", f"n{a if turned else b}", math.pi if turned else 0.0, 0.0 if turned else math.pi, float(rnd.randrange(1, 50))))
            node += 1
        node += 2
        at += n
    ways = spark.createDataFrame(rows, WAYS)
    pairs = {(r.id, r.end): (r.id2, r.end2) for r in N.pair_ends(ways).collect()}
    want = _walk(pairs, {r[0]: r[10] for r in rows})
    got = {r.id: (r.road, r.road_length, r.offset, r.reverse) for r in N.chain_roads(ways).collect()}
    assert got == want
    assert N.chain_roads(ways.limit(0)).count() == 0


def test_a_way_with_a_ref_is_not_bare(spark):
    way = lambda i, name, refs, a, b: (i, 2, 1, False, name, refs, a, b, 0.0, math.pi, 1.0)
    rows = [way(1, "", ["A1"], "p", "q"), way(2, "", [], "q", "r"), way(3, "B", [], "x", "y"), way(4, "", ["A2"], "y", "z"), way(5, "", [], "s", "t"), way(6, "", [], "t", "u")]
    got = {(r.id, r.id2) for r in N.pair_ends(spark.createDataFrame(rows, WAYS)).collect()}
    # bare with numbered: yes, straight on; named with numbered: no; bare with bare: yes
    assert got == {(1, 2), (2, 1), (5, 6), (6, 5)}


def test_turning_back_costs(spark):
    # straight a-b-c is dearer by length, the detour a-d-c turns back at d
    e = [("r", "a", "b", 10.0, 0.0, math.pi), ("r", "b", "c", 10.0, 0.0, math.pi), ("r", "a", "d", 4.0, 0.0, math.pi), ("r", "d", "c", 4.0, math.pi, 0.0), (None, "a", "z", 1.0, 0.0, 0.0)]
    edges = spark.createDataFrame(e, "region string, a string, b string, cost double, heading_a double, heading_b double")
    pairs = spark.createDataFrame([("r", "a", "c", 100.0), ("r", "a", "gone", 1.0)], "region string, a string, b string, straight double")
    assert [(r.cost, r.path) for r in N.route_pairs(edges, pairs, "region").collect()] == [(8.0, "a/d/c")]
    assert [(r.cost, r.path) for r in N.route_pairs(edges, pairs, "region", turn_cost=3000.0).collect()] == [(20.0, "a/b/c")]


def test_gap_links_services_and_flow(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0, 1), ("b", 90.0, 0.0, 1), ("c", 0.0, 50.0, 2), ("d", 300.0, 0.0, 1)], "node string, x double, y double, degree int")
    assert [tuple(r) for r in N.gap_links(nodes).collect()] == [("a", "b", 90.0)]
    t = spark.createDataFrame([(100.0, "rail", "rail"), (100.0, "tram", "rail")], "metres double, service string, wanted string")
    assert sorted(r.cost for r in N.track_edges(t, "wanted").collect()) == [100.0, 400.0]
    routes = spark.createDataFrame([("a", "c", "a/b/c"), ("x", "y", "x/y")], "a string, b string, path string")
    trains = spark.createDataFrame([("a", "c", 10.0), ("x", "y", 30.0)], "a string, b string, trains double")
    corridor = spark.createDataFrame([("a", "b", 1), ("x", "y", 1), ("a", "b", 2)], "node_a string, node_b string, point int")
    got = {(r.a, r.b): r.trains for r in N.track_flow(routes, trains, corridor).collect()}
    assert got == {("a", "b"): 12.5, ("b", "c"): 5.0, ("x", "y"): 20.0}


def test_flow_of_nothing(spark):
    none = spark.createDataFrame([], "a string, b string, path string")
    assert N.track_flow(none, spark.createDataFrame([], "a string, b string, trains double"), spark.createDataFrame([], "node_a string, node_b string, point int")).agg(F.count("*")).first()[0] == 0
