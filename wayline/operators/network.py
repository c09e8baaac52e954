"""Ways to roads, routes over tracks, relaxation over structures, rings and shared borders.

Pairing is a join at nodes and roads are followed by pointer doubling.  What is iterated over a graph runs per connected part: parts are
found by registers.connected and each is one group, so a part must fit one task (a bridge complex, a rail region).
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.registers import connected
from wayline.session import cut, shuffle_width

# Greatest turn (degrees) of a continuation, for unnamed into named ways and for all others.
TURN_UNNAMED, TURN = 35.0, 100.0


def way_ends(ways: DataFrame) -> DataFrame:
    """(way, end, node, heading, ...): both ends of ways.

    ways: id long, kind int (0: never paired), class int, oneway boolean, name string (null or '' unnamed), refs array<string>,
    node0, node1 (any key of the end's place), heading0, heading1 (radians, from the end into the way)."""
    one = lambda e: F.struct(F.lit(e).alias("end"), F.col(f"node{e}").alias("node"), F.col(f"heading{e}").cast("double").alias("heading"))
    x = ways.where("kind <> 0").select("id", "kind", "class", "oneway", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), F.explode(F.array(one(0), one(1))).alias("x"))
    return x.select("id", "kind", "class", "oneway", "name", "refs", "x.end", "x.node", "x.heading").where("node is not null")


def pair_ends(ways: DataFrame) -> DataFrame:
    """(id, end, id2, end2): ends that are each other's best continuation at a node, in both directions.

    Best: a shared ref (3), else the same name (2), else both bare (neither name nor ref) of one class (1), else one of them bare, of one
    class (0, at most 35 degrees); never more than 100 degrees, never against two one-ways; then the straightest, the smaller id, the
    end's code.  Two ways that both have refs, none in common, don't continue each other.  Ends of one ref or name meet at their node; of a
    class, only the nearest by heading are looked at (_straightest), so a node may have any number of them."""
    a = way_ends(ways)
    free = F.coalesce(~F.col("oneway"), F.lit(False))
    a = a.select(
        "id", "kind", "class", "name", "refs", "end", "node", "heading", (free | (F.col("end") == 1)).alias("comes"), (free | (F.col("end") == 0)).alias("goes"),
        (F.size("refs") > 0).alias("refd"), ((F.col("name") == "") & (F.size("refs") == 0)).alias("bare"),
    ).where("abs(heading) < double('inf')")
    named = F.when(F.col("name") != "", F.array(F.struct(F.lit(2).alias("level"), F.col("name").alias("key")))).otherwise(F.array().cast("array<struct<level int, key string>>"))
    keyed = a.where("not bare").select("node", "kind", "id", "end", "heading", "comes", "goes", "refd", F.explode(F.concat(F.transform(F.array_distinct("refs"), lambda r: F.struct(F.lit(3).alias("level"), r.alias("key"))), named)).alias("k"))
    keyed = keyed.select("node", "kind", "k.level", "k.key", "id", "end", "heading", "comes", "goes", "refd")
    on = ["node", "kind", "level", "key"]
    p = keyed.join(keyed.select([F.col(c).alias(c if c in on else f"{c}2") for c in keyed.columns]), on).where("id <> id2 and (level = 3 or not (refd and refd2)) and ((comes and goes2) or (comes2 and goes))")
    off = F.pmod(F.abs(F.col("heading") + math.pi - F.col("heading2")), F.lit(2 * math.pi))
    p = p.select("node", "id", "end", "level", F.least(off, 2 * math.pi - off).alias("turn"), "id2", "end2").unionByName(_straightest(a))
    p = p.where(F.col("turn") <= F.radians(F.when(F.col("level") == 0, TURN_UNNAMED).otherwise(TURN)))
    best = p.groupBy("node", "id", "end").agg(F.min_by(F.struct("id2", "end2"), F.struct(-F.col("level"), "turn", "id2", "end2")).alias("x")).select("node", "id", "end", "x.*")
    back = best.select("node", F.col("id").alias("id2"), F.col("end").alias("end2"), F.col("id2").alias("id"), F.col("end2").alias("end"))
    return best.join(back, ["node", "id", "end", "id2", "end2"]).select("id", "end", "id2", "end2")


def _straightest(ends: DataFrame) -> DataFrame:
    """(node, id, end, level, turn, id2, end2): of each end the straightest other one at its node and class: of the bare ones a bare one (level 1) and
    one that isn't bare (0), of the others a bare one (0).  Found among ends sorted by heading, many nodes to a group."""
    a = ends.where("class is not null and (comes or goes)")
    at = a.where("bare").select("node", "kind", "class").distinct()
    a = a.select("node", "kind", "class", "id", "end", "heading", "comes", "goes", "bare").join(at, ["node", "kind", "class"], "left_semi")
    # the place as text, so that any kind of node can be told apart
    a = a.withColumn("at", F.to_json(F.struct("node", "kind", "class"))).withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(8 * shuffle_width(ends.sparkSession))))
    types = {f.name: f.dataType.simpleString() for f in a.schema}

    def run(t: pa.Table) -> pa.Table:
        g = t["at"].combine_chunks().dictionary_encode().indices.to_numpy()
        ids, ends_, heading = (t[c].to_numpy() for c in ("id", "end", "heading"))
        comes, goes, bare = (t[c].to_numpy() for c in ("comes", "goes", "bare"))
        out = []
        for asks, has, level in ((bare, bare, 1), (bare, ~bare, 0), (~bare, bare, 0)):
            for who, whom in ((comes & goes, comes | goes), (comes & ~goes, goes), (goes & ~comes, comes)):
                q, c = np.flatnonzero(asks & who), np.flatnonzero(has & whom)
                if len(q) and len(c):
                    turn, k = nearest_opposite(g, heading, ids, ends_, q, c, math.radians(TURN if level else TURN_UNNAMED))
                    ok = k >= 0
                    out.append((q[ok], k[ok], turn[ok], np.full(int(ok.sum()), level, np.int32)))
        q, k, turn, level = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return pa.table({"node": t["node"].take(pa.array(q)), "id": t["id"].take(pa.array(q)), "end": t["end"].take(pa.array(q)), "level": pa.array(level, pa.int32()), "turn": pa.array(turn, pa.float64()), "id2": t["id"].take(pa.array(k)), "end2": t["end"].take(pa.array(k))})

    return a.groupBy("bucket").applyInArrow(run, f"node {types['node']}, id {types['id']}, end {types['end']}, level int, turn double, id2 {types['id']}, end2 {types['end']}")


def nearest_opposite(group: np.ndarray, heading: np.ndarray, ids: np.ndarray, ends: np.ndarray, q: np.ndarray, c: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the least turn to a row of ``c`` in its group with another id, and that row (-1: none within ``most``); of equal turns the smaller id, then end.

    Rows of ``c`` are sorted by heading; from the opposite of the asking heading both ways are followed until they lead farther away than the best.
    Rows of one heading are one step: its first row, or the first with another id, stands for all."""
    full = 2 * math.pi
    c = c[np.lexsort((ends[c], ids[c], heading[c], np.mod(heading[c], full), group[c]))]
    cg, ch, cid = group[c], heading[c], ids[c]
    start = np.flatnonzero(np.r_[True, (cg[1:] != cg[:-1]) | (ch[1:] != ch[:-1])])
    run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(c)]))
    second = np.minimum.reduceat(np.where(cid != cid[start][run], np.arange(len(c)), len(c)), start)
    rg, rh = cg[start], ch[start]
    rp, qg, qh, qid = np.mod(rh, full), group[q], heading[q], ids[q]
    o = np.lexsort((np.r_[np.zeros(len(rg)), np.ones(len(q))], np.r_[rp, np.mod(qh + math.pi, full)], np.r_[rg, qg]))
    at = np.empty(len(o), np.int64)
    at[o] = np.cumsum(o < len(rg))
    at = at[len(rg):]
    low = np.searchsorted(rg, qg, "left")
    n = np.searchsorted(rg, qg, "right") - low
    turn, best = np.full(len(q), np.inf), np.full(len(q), -1)
    slack = 1e-12 + 4e-15 * max(np.abs(heading[q]).max(), np.abs(ch).max())
    live = [np.flatnonzero(n > 0)] * 2
    step = 0
    while len(live[0]) or len(live[1]):
        for way in (0, 1):
            i = live[way]
            r = low[i] + (at[i] - low[i] + (step if way else -1 - step)) % n[i]
            off = np.mod(np.abs(qh[i] + math.pi - rh[r]), full)
            d = np.minimum(off, full - off)
            k = np.where(cid[start[r]] != qid[i], start[r], second[r])
            found = k < len(c)
            k = c[np.where(found, k, 0)]
            b, had = best[i], best[i] >= 0
            better = found & (d <= most + slack) & (~had | (d < turn[i]) | ((d == turn[i]) & ((ids[k] < ids[b]) | ((ids[k] == ids[b]) & (ends[k] < ends[b])))))
            turn[i[better]], best[i[better]] = d[better], k[better]
            live[way] = i[(d <= np.minimum(turn[i], most) + slack) & (step + 1 < n[i])]
        step += 1
    return turn, best


def _ends_of(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Where travel that leaves a way by one of its ends comes to: (id, end, last, far, low) for the linked ways out that end, and
    (id, end, low) for those that go round for ever, None if there are none.

    links: id, end, id2, out2, length2 (leaving ``id`` by ``end`` one comes through ``id2`` and out by its end ``out2``); an end without a row is a way out that
    ends at once.  last: the last way, far: the length of the ways after the own one, low: the smallest way among them and the own one.  Each round joins every way
    out with the one its reach ends at, so reaches double: the rounds grow with the logarithm of the longest road."""
    state = cut(links.select("id", "end", F.col("id2").alias("to"), F.col("out2").alias("to_end"), F.col("id2").alias("last"), F.coalesce("length2", F.lit(0.0)).alias("far"), F.least("id", "id2").alias("low")))
    before = None
    while True:
        open_, lows = state.where("to is not null").agg(F.count("*"), F.sum(F.xxhash64("id", "end", "low").cast("decimal(38,0)"))).first()
        if not open_:
            return state.select("id", "end", "last", "far", "low"), None
        # reaches cover every length, so a round in which no way out ends leaves rings; they are known when no smallest way changes any more
        if before == (open_, lows):
            return state.where("to is null").select("id", "end", "last", "far", "low"), state.where("to is not null").select("id", "end", "low")
        before = (open_, lows)
        on = state.select(F.col("id").alias("to"), F.col("end").alias("to_end"), F.col("to").alias("to2"), F.col("to_end").alias("to_end2"), F.col("last").alias("last2"), F.col("far").alias("far2"), F.col("low").alias("low2"))
        going = state.where("to is not null").join(on.hint("merge"), ["to", "to_end"], "left").select("id", "end", F.col("to2").alias("to"), F.col("to_end2").alias("to_end"), F.coalesce("last2", "last").alias("last"), (F.col("far") + F.coalesce("far2", F.lit(0.0))).alias("far"), F.least("low", "low2").alias("low"))
        state = cut(state.where("to is null").unionByName(going))


def chain_roads(ways: DataFrame, length: str = "length") -> DataFrame:
    """(id, road, road_length, offset, reverse): ways as roads; a road is named by its smallest way and runs from the end with the
    smaller way (a closed one from the start of its smallest way).  Ways of kind 0 are roads of their own.

    A ring is opened at the start of its smallest way and is then a road like any other.  No road is ever held in one task."""
    size = ways.select("id", F.col(length).cast("double").alias("length"))
    pairs = pair_ends(ways)
    return _follow(size, pairs.join(size.select(F.col("id").alias("id2"), F.col("length").alias("length2")), "id2").select("id", "end", "id2", (1 - F.col("end2")).alias("out2"), "length2"))


def _follow(size: DataFrame, to: DataFrame) -> DataFrame:
    """chain_roads() of pieces (id, length) by where each of their ends leads (id, end, id2, out2, length2)."""
    links = cut(to.where("id2 is not null"))
    ended, rings = _ends_of(links)
    if rings is not None:
        ring = cut(rings)
        first = F.col("id") == F.col("low")
        opened = links.join(ring.select("id", "end", "low"), ["id", "end"])
        # a ring's smallest way is not left by its start, nor come to through it
        shut = (first & (F.col("end") == 0)) | ((F.col("id2") == F.col("low")) & (F.col("out2") == 1))
        ended = ended.unionByName(_ends_of(opened.where(~shut).select("id", "end", "id2", "out2", "length2"))[0])
    both = ended.groupBy("id").agg(*[F.max(F.when(F.col("end") == e, F.struct("last", "far", "low"))).alias(f"e{e}") for e in (0, 1)])
    # an end that leads nowhere has the way itself as its last one
    last, far = [F.coalesce(f"e{e}.last", "id") for e in (0, 1)], [F.coalesce(f"e{e}.far", F.lit(0.0)) for e in (0, 1)]
    forward = last[0] <= last[1]
    return size.join(both, "id", "left").select(
        "id", F.least("id", "e0.low", "e1.low").alias("road"), (F.col("length") + far[0] + far[1]).alias("road_length"),
        F.when(forward, far[0]).otherwise(far[1]).alias("offset"), F.when(forward, 0).otherwise(1).cast("long").alias("reverse"),
    )


def relax(part: pd.DataFrame, rounds: int = 2000, stop: float = 0.005) -> pd.DataFrame:
    """Heights of a structure's free nodes as means of their neighbours by 1/length, the fixed ones held.
    part: a, b, length, height_a, height_b (null: free)."""
    fixed: dict = {}
    near = defaultdict(list)
    for r in part.itertuples():
        w = 1.0 / max(r.length, 1e-6)
        near[r.a].append((r.b, w))
        near[r.b].append((r.a, w))
        for n, h in ((r.a, r.height_a), (r.b, r.height_b)):
            if not pd.isna(h):
                fixed[n] = float(h)
    start = float(np.mean(list(fixed.values()))) if fixed else 0.0
    h = {n: fixed.get(n, start) for n in sorted(near)}
    for _ in range(rounds if fixed else 0):
        most = 0.0
        for n in h:
            if n not in fixed:
                v = sum(h[m] * w for m, w in near[n]) / sum(w for _, w in near[n])
                most, h[n] = max(most, abs(v - h[n])), v
        if most < stop:
            break
    return pd.DataFrame({"node": list(h), "height": [h[n] if fixed else float("nan") for n in h], "fixed": [n in fixed for n in h]})


def relax_structures(edges: DataFrame) -> DataFrame:
    """relax() per connected structure of edges (a, b, length, height_a, height_b); a structure without a fixed node has no heights."""
    e = edges.withColumn("a", F.col("a").cast("string")).withColumn("b", F.col("b").cast("string")).where("a is not null and b is not null")
    root = connected(e.select("a", "b")).withColumnRenamed("id", "a")
    return e.join(root, "a").groupBy("root").applyInPandas(lambda p: relax(p), "node string, height double, fixed boolean")


class Tracks:
    """An undirected graph of tracks: edges (a, b, cost), and of those with a direction, the headings by which they leave a and b (radians)."""

    def __init__(self, edges: list[tuple]):
        self.near = defaultdict(list)
        for a, b, cost, *at in edges:
            out, back = at if at else (None, None)
            # what is left by, what is arrived by: a track arrives with the heading opposite to the one that leaves its far end
            self.near[a].append((b, cost, out, None if back is None else back + math.pi))
            self.near[b].append((a, cost, back, None if out is None else out + math.pi))

    def search(self, start, goals: dict, turn_cost: float = 0.0, turn: float = math.pi / 2) -> dict:
        """{goal: (cost, nodes)} of the cheapest ways from ``start`` to each of ``goals`` (goal: most it may cost); ties go to the smaller node.

        A change of heading beyond ``turn`` costs ``turn_cost`` more, so what counts is the place and the heading by which one came."""
        open_, most = dict(goals), max(goals.values(), default=0.0)
        heap: list = [(0.0, start, 0, None)]
        came: dict = {}
        rank, got = 0, {}
        while heap and open_:
            cost, n, _, state = heapq.heappop(heap)
            place, heading = (state[0], state[1]) if state else (start, None)
            key = (place, heading) if turn_cost else place
            if key in came:
                continue
            came[key] = state[2] if state else None
            if place in open_:
                if cost <= open_.pop(place):
                    path, at = [place], came[key]
                    while at is not None:
                        path.append(at[0] if turn_cost else at)
                        at = came[at]
                    got[place] = (cost, path[::-1])
            for m, c, leaves, arrives in self.near[place]:
                bend = 0.0
                if turn_cost and heading is not None and leaves is not None:
                    off = abs(heading - leaves) % (2 * math.pi)
                    bend = turn_cost if min(off, 2 * math.pi - off) > turn else 0.0
                after = (m, arrives) if turn_cost else m
                if after not in came and cost + c + bend <= most:
                    rank += 1
                    heapq.heappush(heap, (cost + c + bend, m, rank, (m, arrives, key)))
        return got


def cheapest(edges: list[tuple], start, goal, most: float = math.inf) -> tuple[float, list] | None:
    """Cost and nodes of the cheapest way over undirected (a, b, cost) edges, if it costs at most ``most``; ties go to the smaller node."""
    return Tracks(edges).search(start, {goal: most}).get(goal)


def track_edges(tracks: DataFrame, group: str, wrong: float = 4.0) -> DataFrame:
    """Adds ``cost``: a track's metres, ``wrong`` times as many where its service (column ``service``) isn't the wanted one (column ``group``)."""
    return tracks.withColumn("cost", F.col("metres") * F.when(F.col("service") == F.col(group), 1.0).otherwise(wrong))


def gap_links(nodes: DataFrame, most_m: float = 100.0, factor: float = 1.0) -> DataFrame:
    """(a, b, cost): loose ends (node, x, y in metres, degree 1 only) at most ``most_m`` apart, as links that cost ``factor`` times the distance.  Both once, a < b."""
    cell = lambda c: F.floor(F.col(c) / most_m)
    loose = nodes.where("degree = 1").select("node", "x", "y").distinct()
    a = loose.select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")).select("a", "ax", "ay", "c.cx", "c.cy")
    b = loose.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return a.join(b, ["cx", "cy"]).where(F.col("a") < F.col("b")).withColumn("cost", d * factor).where(d <= most_m).select("a", "b", "cost")


def route_pairs(edges: DataFrame, pairs: DataFrame, region: str, factor: float = 3.0, spare: float = 3000.0, turn_cost: float = 0.0) -> DataFrame:
    """(region, a, b, cost, path) for each wanted pair (region, a, b, straight): the cheapest way over the region's edges
    (region, a, b, cost and, for ``turn_cost``, heading_a, heading_b by which an edge leaves its ends), if it is at most ``factor`` times straight plus ``spare``.

    One region is one group: its graph is built once and searched once per start."""
    bent = "heading_a" in edges.columns

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        g = Tracks(list(zip(*(left[c] for c in ("a", "b", "cost", "heading_a", "heading_b")))))
        out = []
        for start, asked in right.groupby("a", sort=True):
            most = {b: factor * s + spare for b, s in zip(asked["b"], asked["straight"])}
            for b, (cost, path) in g.search(start, most, turn_cost).items():
                out.append((right[region].iloc[0], start, b, cost, "/".join(path)))
        return pd.DataFrame(out, columns=[region, "a", "b", "cost", "path"])

    heading = lambda c: (F.col(c) if bent else F.lit(0.0)).cast("double").alias(c)
    e = edges.select(region, F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("cost").cast("double").alias("cost"), heading("heading_a"), heading("heading_b")).where("a is not null and b is not null and cost is not null")
    p = pairs.select(region, F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("straight").cast("double").alias("straight")).where("a is not null and b is not null")
    t = edges.schema[region].dataType.simpleString()
    return e.groupBy(region).cogroup(p.groupBy(region)).applyInPandas(run, f"{region} {t}, a string, b string, cost double, path string")


def track_flow(routes: DataFrame, trains: DataFrame, corridor: DataFrame) -> DataFrame:
    """(a, b, trains): trains a day over each piece of track.

    routes: a, b, path ('/'-joined nodes); trains: a, b, trains (both directions); corridor: node_a, node_b, point: the points of a corridor at which
    pieces lie side by side.  A pair's trains go over every piece of its path.  At a point the pieces beside each other carry their sum; a
    piece gets the median over its points (the mean of the middle two), halved for one direction; one in no corridor half its own."""
    steps = routes.join(trains, ["a", "b"]).select("trains", F.split("path", "/").alias("p")).where("size(p) > 1").select("trains", F.explode(F.expr("transform(sequence(1, size(p) - 1), i -> struct(least(p[i - 1], p[i]) as na, greatest(p[i - 1], p[i]) as nb))")).alias("s"))
    own = steps.groupBy(F.col("s.na").alias("node_a"), F.col("s.nb").alias("node_b")).agg(F.sum("trains").alias("own"))
    at = corridor.select("node_a", "node_b", "point").distinct().join(own, ["node_a", "node_b"])
    side = at.groupBy("point").agg(F.sum("own").alias("across"))
    mid = at.join(side, "point").groupBy("node_a", "node_b").agg(F.percentile("across", 0.5).alias("across"))
    return own.join(mid, ["node_a", "node_b"], "left").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), (F.coalesce("across", F.col("own").cast("double")) / 2).alias("trains"))


def prominence(heights: np.ndarray, sea: float = 0.0) -> list[tuple[int, int, float]]:
    """(row, column, prominence) of every summit of a height grid: how far one must go down to reach higher ground.

    Cells join in falling order; where two basins meet, the lower summit's saddle is found.  The highest summit's is down to
    ``sea`` or the lowest cell."""
    rows, cols = heights.shape
    flat = heights.ravel()
    order = np.argsort(-flat, kind="stable")
    top = np.full(flat.size, -1)
    root = np.arange(flat.size)
    out: dict[int, float] = {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in order.tolist():
        if np.isnan(flat[i]):
            continue
        r, c = divmod(i, cols)
        near = {find(rr * cols + cc) for rr in range(max(0, r - 1), min(rows, r + 2)) for cc in range(max(0, c - 1), min(cols, c + 2)) if top[rr * cols + cc] >= 0}
        top[i] = i
        if near:
            best = max(near, key=lambda k: (flat[top[k]], -top[k]))
            for k in near - {best}:
                out[int(top[k])] = float(flat[top[k]] - flat[i])
                root[k] = best
            root[i] = best
            top[i] = top[best]
    for i in {find(j) for j in range(flat.size) if top[j] >= 0}:
        out[int(top[i])] = float(flat[top[i]] - max(sea, float(np.nanmin(flat))))
    return sorted(((k // cols, k % cols, v) for k, v in out.items() if v > 0), key=lambda x: (-x[2], x[0], x[1]))


def split_edges(edges: DataFrame, points: DataFrame, cell: int = 64) -> DataFrame:
    """Edges (region, p, q: structs lon, lat of whole numbers) cut at the points (p) that lie on them between their ends, exactly.

    An edge meets the points of the grid cells it runs through, so what is compared is near it; edges and points may both grow."""
    across = lambda c: F.floor(c / cell)
    lo, hi = (lambda f: (f("p.lon", "q.lon"), f("p.lat", "q.lat")))(F.least), (lambda f: (f("p.lon", "q.lon"), f("p.lat", "q.lat")))(F.greatest)
    e = edges.withColumn("id", F.xxhash64("region", "p.lon", "p.lat", "q.lon", "q.lat"))
    # of the cells of an edge's box those that its line can reach
    c = e.withColumn("cx", F.explode(F.sequence(across(lo[0]), across(hi[0])))).withColumn("cy", F.explode(F.sequence(across(lo[1]), across(hi[1]))))
    dx, dy = F.col("q.lon") - F.col("p.lon"), F.col("q.lat") - F.col("p.lat")
    side = lambda x, y: dx * (y * cell - F.col("p.lat")) - dy * (x * cell - F.col("p.lon"))
    corners = [side(F.col("cx") + i, F.col("cy") + j) for i in (0, 1) for j in (0, 1)]
    c = c.where((F.greatest(*corners) >= 0) & (F.least(*corners) <= 0))
    v = points.select(F.col("p").alias("v")).distinct().withColumn("cx", across(F.col("v.lon"))).withColumn("cy", across(F.col("v.lat")))
    on = (dx * (F.col("v.lat") - F.col("p.lat")) == dy * (F.col("v.lon") - F.col("p.lon"))) & F.col("v.lon").between(*[f("p.lon", "q.lon") for f in (F.least, F.greatest)]) & F.col("v.lat").between(*[f("p.lat", "q.lat") for f in (F.least, F.greatest)]) & (F.col("v") != F.col("p")) & (F.col("v") != F.col("q"))
    cuts = c.join(v, ["cx", "cy"]).where(on).groupBy("id").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct((F.abs(F.col("v.lon") - F.col("p.lon")) + F.abs(F.col("v.lat") - F.col("p.lat"))).alias("d"), F.col("v"))))).alias("cuts"))
    x = e.join(cuts, "id", "left").select("region", F.concat(F.array("p"), F.coalesce(F.transform("cuts", lambda k: k["v"]), F.array().cast("array<struct<lon:int,lat:int>>")), F.array("q")).alias("line"))
    x = x.select("region", "line", F.explode(F.sequence(F.lit(0), F.size("line") - 2)).alias("i"))
    return x.select("region", F.get("line", F.col("i")).alias("p"), F.get("line", F.col("i") + 1).alias("q"))


def shared_borders(regions: DataFrame, split: bool = True) -> DataFrame:
    """(x0, y0, x1, y1, left, right): each edge of the regions' rings once, with the region on either side (null outside).

    regions: region, ring (closed array of struct lon, lat, whole numbers; inside on the left).  With ``split`` an edge is cut where a vertex of another
    ring lies on it, so that borders meet piece by piece."""
    e = regions.where("size(ring) > 1").select("region", "ring", F.explode(F.sequence(F.lit(0), F.size("ring") - 2)).alias("i"))
    point = lambda c: F.struct(c["lon"].cast("int").alias("lon"), c["lat"].cast("int").alias("lat"))
    e = e.select("region", point(F.get("ring", F.col("i"))).alias("p"), point(F.get("ring", F.col("i") + 1)).alias("q")).where("p <> q")
    if split:
        e = split_edges(e, e)
    fwd = F.struct(F.col("p.lon"), F.col("p.lat")) < F.struct(F.col("q.lon"), F.col("q.lat"))
    e = e.withColumn("a", F.when(fwd, F.col("p")).otherwise(F.col("q"))).withColumn("b", F.when(fwd, F.col("q")).otherwise(F.col("p"))).withColumn("fwd", fwd)
    g = e.groupBy("a", "b").agg(F.min(F.when(F.col("fwd"), F.col("region"))).alias("left"), F.min(F.when(~F.col("fwd"), F.col("region"))).alias("right"))
    return g.select(F.col("a.lon").alias("x0"), F.col("a.lat").alias("y0"), F.col("b.lon").alias("x1"), F.col("b.lat").alias("y1"), "left", "right")


def border_arcs(borders: DataFrame) -> DataFrame:
    """Borders with their arc, offset (edges from the arc's start) and reverse: arcs run between nodes, the places where other than two edges meet or the regions change.

    Edges that go on are followed as roads are, by doubling; a border without a node is a ring."""
    key = lambda x, y: F.concat_ws("/", x, y)
    sides = F.concat_ws("|", F.array_sort(F.array(F.coalesce("left", F.lit("")), F.coalesce("right", F.lit("")))))
    b = borders.withColumn("id", F.concat_ws("/", "x0", "y0", "x1", "y1")).withColumn("sides", sides)
    ends = b.select("id", "sides", F.explode(F.array(F.struct(F.lit(0).alias("end"), key("x0", "y0").alias("node")), F.struct(F.lit(1).alias("end"), key("x1", "y1").alias("node")))).alias("e")).select("id", "sides", "e.end", "e.node")
    simple = ends.groupBy("node").agg(F.count("*").alias("n"), F.countDistinct("sides").alias("k")).where("n = 2 and k = 1").select("node")
    x = ends.join(simple, "node", "left_semi")
    y = x.select("node", F.col("id").alias("id2"), F.col("end").alias("end2"))
    to = x.join(y, "node").where("id <> id2").select("id", "end", "id2", (1 - F.col("end2")).alias("out2"), F.lit(1.0).alias("length2"))
    arcs = _follow(b.select("id", F.lit(1.0).alias("length")), to)
    return b.join(arcs.select("id", F.col("road").alias("arc"), F.col("offset").cast("int").alias("offset"), "reverse"), "id").drop("id", "sides")


def simplified_arcs(arcs: DataFrame, tolerance: float) -> DataFrame:
    """(arc, left, right, line): each arc once, simplified with its ends kept, so neighbours stay joined; ``arcs`` as from border_arcs.  An arc fits a task."""
    from wayline.functions.geometry import simplify

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        turned = pdf["reverse"].to_numpy() == 1
        first = np.where(turned[:, None], pdf[["x1", "y1"]].to_numpy(), pdf[["x0", "y0"]].to_numpy())
        last = np.where(turned[:, None], pdf[["x0", "y0"]].to_numpy(), pdf[["x1", "y1"]].to_numpy())
        pts = np.vstack([first, last[-1:]]).astype(float)
        closed = len(pts) > 3 and (pts[0] == pts[-1]).all()
        if closed:  # a ring keeps its start and the point farthest from it
            far = int(((pts - pts[0]) ** 2).sum(1).argmax())
            keep = np.append(simplify(pts[: far + 1], tolerance), simplify(pts[far:], tolerance)[1:])
        else:
            keep = simplify(pts, tolerance)
        a, b = (pdf["right"].iloc[0], pdf["left"].iloc[0]) if turned[0] else (pdf["left"].iloc[0], pdf["right"].iloc[0])
        return pd.DataFrame({"arc": [pdf["arc"].iloc[0]], "left": [a], "right": [b], "line": [[f"{int(x)} {int(y)}" for x, y in pts[keep]]]})

    return arcs.groupBy("arc").applyInPandas(run, "arc string, left string, right string, line array<string>")


def ring_area(xs: np.ndarray, ys: np.ndarray) -> float:
    """Signed area of a closed ring, positive with the inside on the left."""
    return float((xs[:-1] * ys[1:] - xs[1:] * ys[:-1]).sum() / 2)


def assemble_rings(lines: list[list[tuple]]) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Closed rings and what stays open, of lines joined end to start; lines that only fit reversed are turned."""
    free = {i: list(x) for i, x in enumerate(lines) if len(x) > 1}
    at = defaultdict(set)
    for i, x in free.items():
        at[x[0]].add(i)
        at[x[-1]].add(i)
    rings, open_ = [], []
    for i in sorted(free):
        if i not in free:
            continue
        cur = free.pop(i)
        for forward in (True, False):
            while cur[0] != cur[-1]:
                tip = cur[-1] if forward else cur[0]
                fits = sorted((k for k in at[tip] if k in free), key=lambda k: ((free[k][0] == tip) != forward, k))
                if not fits:
                    break
                x = free.pop(fits[0])
                if forward:
                    cur += (x if x[0] == tip else x[::-1])[1:]
                else:
                    cur = (x if x[-1] == tip else x[::-1])[:-1] + cur
        (rings if cur[0] == cur[-1] else open_).append(cur)
    return rings, open_


def reach(ways: DataFrame, tile: str, lon: str, lat: str) -> DataFrame:
    """(tile, west, south, east, north, n): the box of what each tile owns."""
    return ways.groupBy(tile).agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"), F.count("*").alias("n"))


def station_spacing(stops: DataFrame, route: str, seq: str, stop: str, length: str, most_km: float = 200.0) -> DataFrame:
    """(stop, spacing): a route's length over its legs, the largest over the routes that serve a stop.

    Consecutive repeats of a stop are one; routes of fewer than two different stops, or with a spacing beyond ``most_km``, say nothing."""
    w = Window.partitionBy(route).orderBy(seq)
    x = stops.withColumn("__p", F.lag(stop).over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.col(stop)))
    r = x.groupBy(route).agg(F.count("*").alias("n"), F.countDistinct(stop).alias("d"), F.max(length).alias("l")).where("d >= 2").withColumn("spacing", F.col("l") / (F.col("n") - 1)).where(F.col("spacing") <= most_km)
    return x.select(route, stop).distinct().join(r.select(route, "spacing"), route).groupBy(stop).agg(F.max("spacing").alias("spacing"))
