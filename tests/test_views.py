"""The map's queries: wrong parameters, empty tables, nulls and ties; small operators by hand."""

import math

import pytest
from pyspark.sql import functions as F

from wayline.functions import tags as G
from wayline.operators import details as D
from wayline.operators import landmarks as L
from wayline.operators import timetables as T
from wayline.operators import views as V

SAMPLES = "road long, off long, way long, lon double, lat double, ch array<int>, eye double, flags int"
WAYS = "way long, class int, flags int, name string, ref string, road_m double"
MARKS = "kind string, id long, lon double, lat double, fa double, ia double, rank long, kz int, tier string, flags int, name string, size double"


def _samples(spark, n=30, gap=()):
    off = [i * 100 + (1000 if i in gap else 0) for i in range(n)]
    rows = [(1, o, o // 1000, 0.001 * i, 1.0, [200 if 10 <= i < 20 else 20] * 13, 5.0, 0) for i, o in enumerate(off)]
    return spark.createDataFrame(rows, SAMPLES)


def test_drives(spark):
    s = _samples(spark)
    w = spark.createDataFrame([(k, 4, 0, f"R{k}", None, 9000.0) for k in range(4)] + [(9, 4, 8, "F", None, 1.0)], WAYS)
    r = V.drives(s, w, (-1.0, 0.0, 1.0, 2.0), [1.0] * 12, length_km=0.5).collect()
    assert len(r) == 1 and r[0].place == 1 and r[0].total == 1 and 1000 <= r[0].off0 and r[0].off1 <= 2000 and len(r[0].geom) == 6 and r[0].parts[0] == pytest.approx(200 / 255)
    assert V.drives(s, w, (5.0, 0.0, 6.0, 2.0), [1.0] * 12, length_km=0.5).count() == 0
    assert V.drives(s, w, (-1.0, 0.0, 1.0, 2.0), [1.0] * 12, length_km=50.0).count() == 0
    assert V.drives(s.limit(0), w, (-1.0, 0.0, 1.0, 2.0), [1.0] * 12).count() == 0 and V.drives(s, w, (-1.0, 0.0, 1.0, 2.0), [1.0] * 12, length_km=0.5, limit=0).count() == 0
    with pytest.raises(ValueError):
        V.drives(s, w, (-1.0, 0.0, 1.0, 2.0), [1.0] * 11)


def test_rides_and_identity(spark):
    s = _samples(spark)
    w = spark.createDataFrame([(k, 12, 0, "Sleeper: A => B", "x · y", 5, 7) for k in range(4)], "way long, class int, rail int, name string, route string, colour int, rel long")
    t = spark.createDataFrame([(1, 50.0)], "way long, trains double")
    r = V.rides(s, w, t, [(-1.0, 0.0), (1.0, 0.0), (1.0, 2.0), (-1.0, 2.0)], [1.0] * 11, length_km=0.5).collect()
    assert [(x.line, x.rel, x.total) for x in r] == [("Sleeper", 7, 1)]
    assert V.rides(s, w, t, (-1.0, 0.0, 1.0, 2.0), [1.0] * 11, groups=0b1000).count() == 0
    names = spark.createDataFrame([("Paris => Lyon", None), ("Lyon => Paris: TGV", None), ("", "S1 · S2"), (None, None)], "n string, r string")
    assert [x[0] for x in names.select(V.rail_identity(F.col("n"), F.col("r"))).collect()] == ["Lyon – Paris", "Lyon – Paris", "S1", ""]


def test_marks_view(spark):
    rows = [("a", i, 0.0, 0.0, float(i % 4), 10.0, i, i % 7, "t" if i % 2 else None, 1 if i % 3 else 0, f"n{i}", float(i) if i % 5 else None) for i in range(40)] + [("b", 99, 50.0, 0.0, 1.0, 1.0, 1, 0, None, 1, "far", None), ("a", 77, 0.0, 0.0, 3.0, 1.0, 77, 0, None, 2, "component", 1.0)]
    m = spark.createDataFrame(rows, MARKS)
    v = V.marks_view(m, (-1.0, -1.0, 1.0, 1.0), ["a", "b"], 0.0, 3, (2, 10), {"a": ["t"]}, {"a": {"size": (5.0, None)}}, (), {"a": {"size": (F.col("size"), 0.0, 40.0)}}, 3)
    ids = {r.id for r in v["candidates"].collect()}
    assert ids == {i for i in range(40) if i % 2 == 0 and i % 5 and i >= 5}
    assert [r.id for r in v["top"].collect()] == sorted(ids, key=lambda i: (-(i % 4), i))[:3]
    assert {(r.kind, r.n) for r in v["by_kind"].collect()} == {("a", len(ids))} and v["histogram"].agg(F.sum("n")).first()[0] == len(ids)
    assert v["filters"].agg(F.sum("n")).first()[0] == len([i for i in range(40) if i % 2 == 0 and i % 5])
    assert all(r.kz > 3 for r in v["extra"].collect())
    empty = V.marks_view(m.limit(0), (-1.0, -1.0, 1.0, 1.0), ["a"], zoom=3)
    assert all(df.count() == 0 for k, df in empty.items())


def test_parks_and_places(spark):
    parks = spark.createDataFrame([(1, "Big", 0.0, 0.0, 10.0, 10.0, 100.0), (2, " big", 4.0, 4.0, 6.0, 6.0, 4.0), (3, "Far", 20.0, 20.0, 21.0, 21.0, 1.0), (4, None, 0.0, 0.0, 1.0, 1.0, 1.0)], "park int, name string, west double, south double, east double, north double, area double")
    asks = spark.createDataFrame([(1, "BIG", 5.0, 5.0), (2, "big", 1.0, 1.0), (3, "far", 21.04, 20.5), (4, "far", 30.0, 20.0), (5, None, 0.0, 0.0)], "ask int, name string, lon double, lat double")
    assert {r.ask: r.park for r in V.park_at(parks, asks).collect()} == {1: 2, 2: 1, 3: 3}
    p = spark.createDataFrame([(1, "New York", 7, 0.0, 0.0), (2, "York", 6, 0.0, 0.0), (3, "Newark on York", 7, 1.0, 0.0), (4, None, 7, 0.0, 0.0), (5, "東京", 7, 0.0, 0.0)], "place int, name string, rank int, lon double, lat double")
    ix = V.place_index(p)
    assert [r.place for r in V.find_places(ix, "yor ne", 0.9, 0.0).collect()] == [3, 1] and [r.place for r in V.find_places(ix, "york york", 0.0, 0.0).collect()] == [1, 3, 2]
    assert V.find_places(ix, "y", 0.0, 0.0).count() == 0 and [r.place for r in V.find_places(ix, "東京", 0.0, 0.0).collect()] == [5]


def test_runs_and_codes(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 6, 8), (2, 3, 2), (1, 100, 300)], "row int, first int, last int")
    b = spark.createDataFrame([(1, 7, 9), (1, 150, 160), (1, 290, 400)], "row int, first int, last int")
    assert sorted(tuple(r) for r in D.runs_or(a, b).collect()) == [(1, 0, 9), (1, 100, 400)]
    assert sorted(tuple(r) for r in D.runs_and(a, b, 16).collect()) == [(1, 7, 8), (1, 150, 160), (1, 290, 300)]
    assert D.runs_or(a.limit(0), b.limit(0)).count() == 0 and D.runs_and(a, b.limit(0)).count() == 0
    assert D.tile_run(0, 0, 0) == (0, 1 << 32) and D.tile_run(17, 5, 3) == D.tile_run(16, 2, 1)


def test_styles_and_alpha(spark):
    df = spark.createDataFrame([(9, 0), (8, 2), (8, 4), (3, 8)], "c int, f int")
    got = [tuple(r) for r in df.select(D.style_of(F.col("c"), F.col("f")).alias("s")).select("s", D.draw_key(F.col("s"))).collect()]
    assert got == [(9, 9), (40, 40), (72, 8), (19, 19)]
    c = lambda v: F.struct(F.lit(v).alias("r"), F.lit(v).alias("g"), F.lit(v).alias("b"))
    a = spark.range(1).select(D.water_alpha(F.lit(0.0), c(0), c(255)), D.water_alpha(F.lit(1.0), c(0), c(255)), D.water_alpha(F.lit(0.5), c(9), c(9)), D.water_alpha(F.lit(0.5), c(0), c(255))).first()
    assert a[0] == pytest.approx(0) and a[1] == pytest.approx(255) and a[2] == 127.5 and a[3] < 127.5
    with pytest.raises(ValueError):
        D.colour_metric("none", F.lit(0.0), F.lit(0.0), F.array())


def test_tags(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    tags = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in (p[0].replace("__", ":"), p[1])])
    assert one(G.service_group(tags(route="tram"))) == 0 and one(G.service_group(tags(route="bus"))) is None and one(G.service_group(tags(route="train", name="TGV 1"))) == 3
    assert one(G.service_group(tags(route="tram", heritage__railway="yes"))) == 4
    assert one(G.own_english(F.create_map(F.lit("name:zh-Latn-pinyin"), F.lit("B"), F.lit("name:ja_rm"), F.lit("A")))) == "A" and one(G.own_english(tags(name="x"))) is None
    assert one(G.population(F.lit("1,234 5;7"))) == 12345.0 and one(G.population(F.lit("x"))) == 0.0 and one(G.population(F.lit(None).cast("string"))) == 0.0
    assert one(G.place_rank(F.lit("quarter"))) == 3 and one(G.place_rank(F.lit("x"))) is None


def test_ferries_and_stars(spark):
    lines = spark.createDataFrame([("L", 0.0, 0.0, 5000.0, 0.0), ("short", 0.0, 9000.0, 100.0, 9000.0)], "line string, ax double, ay double, bx double, by double")
    calls = spark.createDataFrame([("t1", "a", 1, 100, 10.0, 0.0), ("t1", "b", 2, 200, 5100.0, 0.0), ("t2", "b", 1, 50, 5100.0, 0.0), ("t2", "a", 2, 90, 10.0, 0.0), ("t3", "a", 1, 5, 10.0, 0.0), ("t4", "c", 1, 5, 50.0, 9000.0)], "trip string, stop string, seq int, at int, x double, y double")
    assert sorted(tuple(r) for r in T.ferry_ends(lines, calls).collect()) == [("L", "t1", "a", "b", 100), ("L", "t2", "b", "a", 50)]
    text = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    star = T.timetable_star(
        text([("r", "2")], "route_id route_type"), text([("t", "r", "s"), ("u", "r", "none")], "trip_id route_id service_id"), text([("t", "x", "1", "08:00:00", None), ("t", "y", "2", None, "08:10:00"), ("t", "y", "z", None, None)], "trip_id stop_id stop_sequence departure_time arrival_time"),
        text([("x", "1", "2"), ("y", "3", "4")], "stop_id stop_lon stop_lat"), text([("s", "2024-01-01")], "service_id date"), text([("t", "6:00:00", "7:00:00", "600")], "trip_id start_time end_time headway_secs"),
    )
    assert sorted((r.stop_id, r.seq, r.at, r.per_day, r["mode"]) for r in star.collect()) == [("x", 1, 28800, 6, "rail"), ("y", 2, 29400, 6, "rail")]
    cal = text([("w", "1", "1", "1", "1", "1", "1", "1", "20201230", "20210102"), ("leap", "1", "1", "1", "1", "1", "1", "1", "20200229", "20200301"), ("bad", *"1111111", "", "x")], "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date")
    got = {}
    for r in T.yearly_dates(cal).collect():
        got.setdefault(r.service_id, set()).add(str(r.date)[5:])
    assert got == {"w": {"12-30", "12-31", "01-01", "01-02"}, "leap": {"02-28", "03-01"}}


def test_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("k", 1.0, 5), ("k", 1.0, 3), ("k", 9.0, 1), ("k", None, 2), ("j", 4.0, 200_000), ("j", 4.0, 4)], "g string, v double, id long")
    assert {(r.id, r["rank"]) for r in L.rank_from_below(df, ["g"], "v", "id").collect()} == {(3, 0), (5, 1), (1, 2), (4, 0), (200_000, 1)}
    assert {r.id: r.share for r in L.rank_by_counts(df, "v").collect()} == {5: 0.4, 3: 0.4, 1: 1.0, 2: 0.0, 4: 0.8, 200_000: 0.8}
    assert L.score_at_ranks(df.limit(0), "v", [1]).count() == 0 and {r["rank"]: r.score for r in L.score_at_ranks(df, "v", [0, 1, 2, 99]).collect()} == {0: 9.0, 1: 9.0, 2: 4.0, 99: 1.0}


def test_terrain_and_boxes(spark):
    s = spark.createDataFrame([(0, 0, 0.5, 10.0, False), (0, 0, 0.5, 10.0, True), (0, 0, 0.5, None, False), (0, 0, 0.5, float("nan"), False), (0, 0, 0.5, 1e9, None)], "z int, y int, row double, h double, w boolean")
    assert {(r.bin, round(r.weight, 9)) for r in D.terrain_distribution(s, "h", 0.0, 100.0, 10, "w").collect()} == {(1, 1.0), (9, 1.0)}
    seg = spark.createDataFrame([("a", -1.0, 0.0, 1.0, 0.0), ("a", 0.0, 5.0, 0.0, 9.0), ("b", 0.0, 0.0, 0.0, 0.0)], "g string, x0 double, y0 double, x1 double, y1 double")
    got = {r.g: r.km for r in D.km_in_box(seg, "g", (0.0, -1.0, 2.0, 1.0)).collect()}
    assert list(got) == ["a"] and math.isclose(got["a"], D.KM_LON)
