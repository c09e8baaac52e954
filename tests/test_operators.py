"""Reference operators on small inputs, against brute force where SQL has no say."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.functions import scoring as S
from wayline.operators import landmarks as L
from wayline.operators import lookups as J
from wayline.operators import network as N
from wayline.operators import pyramids as P
from wayline.operators import registers as R
from wayline.operators import sequences as Q
from wayline.operators import timetables as T
from wayline.sources import register
from wayline.sources import files as files_
from wayline.sources import osm, pmtiles, vector_tiles
from wayline.streaming import maplog as M


def test_best_window_against_brute_force(spark):
    rnd = random.Random(3)
    rows, at = [], 0
    for i in range(400):
        at += rnd.choice([0, 1, 5, 40, 90])
        rows.append(("hot" if i % 3 else "b", at, rnd.random(), i))
    df = spark.createDataFrame(rows, "road string, off long, score double, n int")
    got = {r.road: r for r in Q.best_window(df, ["road"], "off", "score", 100, 400, tie="n", block=700).collect()}
    for road in ("hot", "b"):
        x = sorted((o, n, s) for r, o, s, n in rows if r == road)
        best = None
        for i in range(len(x)):
            j = next((j for j in range(i, len(x)) if x[j][0] - x[i][0] >= 100), None)
            if j is not None and (best is None or (m := sum(v[2] for v in x[i : j + 1]) / (j + 1 - i)) > best[0] + 1e-12):
                best = (sum(v[2] for v in x[i : j + 1]) / (j + 1 - i), x[i][0], x[j][0])
        assert math.isclose(got[road].mean, best[0], abs_tol=1e-9) and (got[road].off0, got[road].off1) == best[1:]
    assert Q.best_window(df.limit(0), ["road"], "off", "score", 100, 400).count() == 0


def test_islands_over_chunks(spark):
    rows = [("a", p) for p in (0, 5, 5, 300, 301, 900, 2000)] + [(None, 1), ("a", None)]
    df = spark.createDataFrame(rows, "road string, off long")
    for chunk in (1, 250, 10_000):
        got = sorted((r.off, r.run) for r in Q.islands(df, "road", "off", 300, chunk).collect())
        assert got == [(0, 0), (5, 0), (5, 0), (300, 0), (301, 0), (900, 900), (2000, 2000)]


def test_thinning_keeps_ends_and_extrema():
    keep = Q.thin_with_extrema(np.array([0, 1, 2, 3, 4, 5.0]), np.array([0, 5, 0, 1, 1, 1.0]), 10, 2)
    assert keep.tolist() == [True, True, True, False, False, True]


def test_pairs_and_chains(spark):
    cols = "id long, kind int, class int, oneway boolean, name string, refs array<string>, node0 string, node1 string, heading0 double, heading1 double, length double"
    east, west = 0.0, math.pi
    rows = [
        (3, 2, 1, False, "A", [], "p", "q", east, west, 10.0), (1, 2, 1, False, "A", [], "q", "r", east, west, 20.0), (2, 2, 1, False, "B", [], "q", "s", 1.5, -1.6, 5.0),
        (7, 0, 1, False, "A", [], "r", "t", east, west, 1.0), (10, 2, 1, False, "R", [], "x", "y", 0.0, 0.3, 1.0), (11, 2, 1, False, "R", [], "y", "x", 0.3 + math.pi, math.pi, 1.0),
    ]
    got = {r.id: (r.road, r.road_length, r.offset, r.reverse) for r in N.chain_roads(spark.createDataFrame(rows, cols)).collect()}
    assert got[1] == (1, 30.0, 0.0, 1) and got[3] == (1, 30.0, 20.0, 1)
    assert got[2] == (2, 5.0, 0.0, 0) and got[7] == (7, 1.0, 0.0, 0)
    assert got[10][0] == got[11][0] == 10


def test_connected_random(spark):
    rnd = random.Random(1)
    e = [(f"{rnd.randrange(300):03d}", f"{rnd.randrange(300):03d}") for _ in range(200)] + [("999", "999"), (None, "1"), ("000", "001")]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.root for r in R.connected(spark.createDataFrame(e, "a string, b string")).collect()}
    assert got == {k: find(k) for k in root}


def test_relax_routes_prominence_rings(spark):
    e = spark.createDataFrame([("a", "b", 1.0, 0.0, None), ("b", "c", 1.0, None, 10.0), ("x", "y", 1.0, None, None)], "a string, b string, length double, height_a double, height_b double")
    got = {r.node: r.height for r in N.relax_structures(e).collect()}
    assert abs(got["b"] - 5) < 0.02 and got["x"] is None
    assert N.cheapest([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 3.0)], "a", "c") == (2.0, ["a", "b", "c"])
    assert N.cheapest([("a", "b", 5.0)], "a", "b", 4.0) is None
    h = np.array([[1, 1, 1, 1, 1], [1, 9, 3, 5, 1], [1, 1, 1, 1, 1.0]])
    assert N.prominence(h) == [(1, 1, 8.0), (1, 3, 2.0)]
    rings, open_ = N.assemble_rings([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 0)], [(5, 5), (6, 6)]])
    assert len(rings) == 1 and rings[0][0] == rings[0][-1] and open_ == [[(5, 5), (6, 6)]]
    assert N.ring_area(np.array([0, 1, 1, 0.0]), np.array([0, 0, 1, 0.0])) == 0.5


def test_nearest_better_random(spark):
    rnd = random.Random(9)
    rows = [(i % 2, i, rnd.uniform(-180, 180), rnd.uniform(-89, 89), float(rnd.randrange(20))) for i in range(120)]
    df = spark.createDataFrame(rows, "kind int, id int, lon double, lat double, score double")
    got = {r.id: r.km for r in L.nearest_better(df, ["kind"], "id", "lon", "lat", "score").collect()}

    def km(p, q):
        a, b, c, d = map(math.radians, (p[2], p[3], q[2], q[3]))
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2)))

    for p in rows:
        want = min([km(p, q) for q in rows if q[0] == p[0] and (q[4] > p[4] or (q[4] == p[4] and q[1] < p[1]))] + [20000.0])
        assert math.isclose(got[p[1]], want, rel_tol=1e-9)


def test_views(spark):
    df = spark.createDataFrame([(175.0, 0.0), (-170.0, 0.0), (0.0, 0.0), (10.0, 85.0), (-100.0, 80.0), (10.0, -85.0)], "lon double, lat double")
    see = lambda ring: [r[0] for r in df.select(R.view_holds(ring, df["lon"], df["lat"])).collect()]
    assert see([(170.0, -10.0), (-160.0, -10.0), (-160.0, 10.0), (170.0, 10.0)]) == [True, True, False, False, False, False]
    assert see([(x * 30.0, 70.0) for x in range(12)]) == [False, False, False, True, True, False]
    assert see([(0.0, 1.0)]) == [False] * 6


def test_greedy_merge_and_labels(spark):
    p = spark.createDataFrame([("b1", "small", "a1", "big"), ("b1", "small", "a2", "big"), ("c1", "tiny", "b1", "small")], "a string, a_register string, b string, b_register string")
    got = {tuple(r) for r in R.greedy_merge(p, ["big", "small", "tiny"]).collect()}
    assert ("b1", "a1") in got and all(d != "a1" and d != "a2" for d, _ in got)
    df = spark.createDataFrame([("w", "L", 0.0, 0.0, 3.0), ("w", "L", 0.1, 0.0, 2.0), ("w", "L", 2.0, 0.0, 1.0), ("w", None, 0.0, 0.0, 9.0)], "kind string, name string, lon double, lat double, imp double")
    assert sorted(r.imp for r in R.repeated_labels(df, "kind", "name", "lon", "lat", "imp").collect()) == [1.0, 3.0]


def test_scores(spark):
    ch = [[255, 0, 200, 128 + 30, 100, 0, 0, 1 | 4, 0, 0, 0, 0, 0]]
    df = spark.createDataFrame([(ch[0],)], "ch array<int>")
    got = df.select(*[c.alias(f"c{i}") for i, c in enumerate(S.drive_components(F.col("ch")))]).first()
    assert list(got) == [1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.landmark_score(F.lit(5.0), F.lit(20000.0), 0.0)) == 1.0
    assert abs(one(S.ride_score([F.lit(1.0), F.lit(0.0)], F.lit(0.0), [1.0, 5.0])) - 1.0) < 1e-12
    assert one(S.area_code(F.lit(700.0))) == 255 and abs(one(S.area_km2(F.lit(255))) - 700) < 1e-6
    assert one(S.grade_percent(F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(10.0))) == 30.0


def test_geometry():
    line = np.array([[0, 0], [1, 0.01], [2, 0], [3, 2], [4, 0.0]])
    assert G.simplify(line, 0.1).tolist() == [True, False, True, True, True]
    box = G.clip_ring([(-1, -1), (3, -1), (3, 3), (-1, 3), (-1, -1)], 0, 0, 2, 2)
    assert sorted(set(box)) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert len(G.clip_line(np.array([[-1, 0.5], [3, 0.5], [3, 5], [1, 5], [1, -1.0]]), 0, 0, 2, 2)) == 2
    sq = np.array([[1, 1], [4, 1], [4, 4], [1, 4], [1, 1.0]])
    assert G.fill_polygon([sq], 6, 6).sum() == 9 and G.coverage([sq], 6, 6).sum() == pytest.approx(9)
    half = np.array([[0.5, 0], [2, 0], [2, 1], [0.5, 1], [0.5, 0.0]])
    assert G.coverage([half], 3, 2)[0].tolist() == pytest.approx([0.5, 1, 0])
    assert G.touch_line(np.array([[0.5, 0.5], [2.5, 1.5]]), 3, 3).sum() >= 4
    seeds = np.zeros((7, 9), bool)
    seeds[2, 3] = seeds[6, 8] = True
    yy, xx = np.mgrid[0:7, 0:9]
    want = np.minimum(np.hypot(yy - 2, xx - 3), np.hypot(yy - 6, xx - 8))
    assert np.allclose(G.distance_transform(seeds), want) and np.isinf(G.distance_transform(np.zeros((2, 2), bool))).all()
    flat = np.zeros((41, 41))
    seen = G.viewshed(flat, None, None, 20.5, 20.5, 100.0, 2.0, 1500.0, 512)
    wall = flat.copy()
    wall[:, 25] = 500
    assert G.viewshed(wall, None, None, 20.5, 20.5, 100.0, 2.0, 1500.0, 512)["visible_km2"] < seen["visible_km2"] and seen["visible_share"] > 0.95
    assert len(G.contours(np.array([[0, 0], [0, 10.0]]), 5)) == 1
    x, y = G.equal_area(np.array([10.0, -20.0]), np.array([40.0, 70.0]), 0.0, 50.0)
    lon, lat = G.equal_area_back(x, y, 0.0, 50.0)
    assert np.allclose(lon, [10, -20]) and np.allclose(lat, [40, 70])
    for north in (True, False):
        a, b = G.polar_back(*G.polar(np.array([30.0, -120.0]), np.array([80.0, 60.0]) * (1 if north else -1), north), north)
        assert np.allclose(a, [30, -120]) and np.allclose(np.abs(b), [80, 60])
    assert G.lake_bowl(seeds, 10, 5.0).max() == 5.0 and G.bilinear(np.array([[0, 2.0]]), np.array([1.0]), np.array([0.5]))[0] == 1.0


def test_timetables(spark):
    cal = spark.createDataFrame([("s", "1", "0", "0", "0", "0", "0", "1", "20240101", "20240110"), ("bad", "1", "1", "1", "1", "1", "1", "1", "x", "20240101")], "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string")
    exc = spark.createDataFrame([("s", "20240107", "2"), ("s", "20240103", "1")], "service_id string, date string, exception_type string")
    assert sorted(str(r.date) for r in T.service_dates(cal, exc).collect()) == ["2024-01-01", "2024-01-03", "2024-01-08"]
    f = spark.createDataFrame([("t", "25:00:00", "25:30:00", "600"), ("u", "x", "1:0:0", "60")], "trip_id string, start_time string, end_time string, headway_secs string")
    assert sorted(r.start for r in T.expand_frequencies(f).collect()) == [90000, 90600, 91200]
    t = spark.createDataFrame([("f1", "a", 1.001, 2.0, 3.0, 4.0, 60, 120, "rail"), ("f2", "b", 1.004, 2.0, 3.0, 4.0, 61, 125, "rail")], "feed string, trip_id string, lon0 double, lat0 double, lon1 double, lat1 double, start int, end int, mode string")
    assert [tuple(r) for r in T.distinct_trips(t).collect()] == [("f1", "a")]
    d = spark.createDataFrame([("x", "2024-01-01"), ("x", "2024-03-01"), ("y", "2024-01-01")], "k string, d string").withColumn("d", F.to_date("d"))
    assert {r.k: r.seasonal for r in T.seasonal(d, "k", "d").collect()} == {"x": True, "y": False}
    assert [r[0] for r in spark.createDataFrame([("2",), ("101",), ("1000",), ("zz",)], "t string").select(T.mode_of(F.col("t"))).collect()] == ["rail", "rail", "ferry", "other"]


def test_lookups_on_empty(spark):
    e = spark.createDataFrame([], "id long, west long, south long, east long, north long")
    assert J.boxes_meet(e, e, 10.0).count() == 0
    assert P.weighted_quantiles(spark.createDataFrame([], "g string, v double, w double"), "v", "w", ["g"], [0.5]).count() == 0


def test_pmtiles_and_vector_tiles(spark, tmp_path):
    for i in (0, 1, 4, 5, 84, 1000, 123456):
        assert pmtiles.zxy_to_id(*pmtiles.id_to_zxy(i)) == i
    feats = [{"layer": "a", "id": 7, "type": 1, "parts": [[(5, 6)]], "tags": {"name": "x", "n": 3, "f": 1.5, "b": True}}, {"layer": "b", "id": None, "type": 3, "parts": [[(0, 0), (9, 0), (9, 9), (0, 0)]], "tags": {}}, {"layer": "b", "id": 2, "type": 2, "parts": [[(1, 1), (4, 2)], [(7, 7), (8, 8)]], "tags": {}}]
    tile = vector_tiles.encode(feats)
    assert vector_tiles.decode(tile) == feats
    pmtiles.write_archive(str(tmp_path / "t.pmtiles"), {(1, 0, 0): tile, (1, 1, 0): tile, (3, 5, 5): b"other"})
    register(spark)
    df = spark.read.format("pmtiles").load(str(tmp_path / "t.pmtiles"))
    assert sorted((r.z, r.x, r.y, bytes(r.data)) for r in df.collect()) == [(1, 0, 0, tile), (1, 1, 0, tile), (3, 5, 5, b"other")]
    rows = vector_tiles.read_tiles(df.where("z = 1")).collect()
    assert len(rows) == 6 and {r.layer for r in rows} == {"a", "b"}
    pts = spark.createDataFrame([(1, 0, 0, "p", 1, 10, 20, "n"), (1, 0, 0, "p", 2, 11, 21, None)], "z int, x int, y int, layer string, id long, px int, py int, name string")
    assert len(vector_tiles.decode(bytes(vector_tiles.write_point_tiles(pts).first().data))) == 2


def _field(n, kind, body):
    return vector_tiles._field(n, kind, body)


def test_osm_pbf(spark, tmp_path):
    v = pmtiles.write_varint
    zz = lambda x: (x << 1) ^ (x >> 63)
    pack = lambda xs: b"".join(map(v, xs))
    texts = b"".join(_field(1, 2, s) for s in (b"", b"name", b"Peak", b"stop"))
    dense = _field(1, 2, pack([zz(10), zz(2)])) + _field(8, 2, pack([zz(450000000), zz(100)])) + _field(9, 2, pack([zz(-70000000), zz(0)])) + _field(10, 2, pack([1, 2, 0, 0]))
    way = _field(1, 0, v(5)) + _field(2, 2, pack([1])) + _field(3, 2, pack([2])) + _field(8, 2, pack([zz(10), zz(2)]))
    rel = _field(1, 0, v(6)) + _field(8, 2, pack([3])) + _field(9, 2, pack([zz(5)])) + _field(10, 2, pack([1]))
    block = _field(1, 2, texts) + _field(2, 2, _field(2, 2, dense)) + _field(2, 2, _field(3, 2, way)) + _field(2, 2, _field(4, 2, rel))
    import zlib

    out = b""
    for kind, data in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = _field(2, 0, v(len(data))) + _field(3, 2, zlib.compress(data))
        head = _field(1, 2, kind) + _field(3, 0, v(len(blob)))
        out += len(head).to_bytes(4, "big") + head + blob
    p = tmp_path / "x.osm.pbf"
    p.write_bytes(out)
    register(spark)
    got = {(r.type, r.id): r for r in spark.read.format("osmpbf").load(str(p)).collect()}
    assert set(got) == {("node", 10), ("node", 12), ("way", 5), ("relation", 6)}
    assert (got[("node", 10)].lon, got[("node", 10)].lat, got[("node", 10)].tags) == (-70000000, 450000000, {"name": "Peak"})
    assert got[("way", 5)].refs == [10, 12] and got[("relation", 6)].roles == ["stop"] and got[("relation", 6)].kinds == ["way"]
    assert osm.blobs(str(p))[1][2] == "OSMData"


def test_files(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("a/stops.txt", "old\n1\n")
        z.writestr("b/stops.txt", '﻿stop_id, stop_name\n1,"A, b"\n2\n')
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    rows = files_.read_gtfs(spark, str(tmp_path / "*.zip")).cache()
    assert sorted((r.stop_id, r.stop_name or "") for r in files_.gtfs_table(rows, "stops", ["stop_id", "stop_name"]).collect()) == [("1", "A, b"), ("2", "")]
    assert rows.where("file is null").count() == 1
    (tmp_path / "s.geojsonseq").write_text('\x1e{"a":1}\n\x1e{"a":2}\nbroken\n\n')
    assert sorted((r.a or 0) for r in files_.read_json_lines(spark, str(tmp_path / "s.geojsonseq"), "a int").collect()) == [0, 1, 2]
    rgb = spark.range(1).select(files_.terrarium_rgb(F.lit(123.5)).alias("c")).select(files_.terrarium_metres(F.col("c.red"), F.col("c.green"), F.col("c.blue"))).first()[0]
    assert rgb == 123.5
    df = spark.createDataFrame([(1, b"x"), (2, b"x"), (3, b"y")], "id int, data binary")
    files_.write_pack(df, str(tmp_path / "pack"), "data")
    assert spark.read.parquet(str(tmp_path / "pack/blobs")).count() == 2 and files_.read_pack(spark, str(tmp_path / "pack")).count() == 3
    m = spark.createDataFrame([("peak", 1, 10.0, 50.0), ("rest", 2, 11.0, 50.0)], "kind string, id int, lon double, lat double")
    files_.write_marks(m, str(tmp_path / "marks"))
    assert spark.read.parquet(str(tmp_path / "marks")).where("kind = 'peak'").count() == 1
    b = spark.createDataFrame([(1, (0.0, 0.0, 1.0, 1.0)), (2, (5.0, 5.0, 6.0, 6.0))], "id int, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    b.write.parquet(str(tmp_path / "boxes"))
    assert [r.id for r in files_.read_boxes(spark, str(tmp_path / "boxes"), 0.5, 0.5, 2, 2, ["id"]).collect()] == [1]


def _batches(spark, rows):
    return spark.createDataFrame([(s, "", "t", "", st, dl, [], None) for s, st, dl in rows], M.BATCH)


def test_log_faults_and_restart(spark, tmp_path):
    none = spark.createDataFrame([], M.NOTHING)
    b = _batches(spark, [(1, {"a": "1", "b": "2"}, []), (2, {"a": "3"}, ["b"]), (4, {}, ["zz"])])
    assert {tuple(r) for r in M.apply_batches(none, b).collect()} == {("a", "3")}
    assert [tuple(r) for r in M.check_batches(none, b, 0).collect()] == [(4, "gap")]
    wrong = b.withColumn("digest", F.lit(5).cast("decimal(20,0)")).where("seq = 1")
    assert [tuple(r) for r in M.check_batches(none, wrong, 0).collect()] == [(1, "digest")]
    store = M.StateStore(spark, str(tmp_path / "state"))
    for k, rows in enumerate(([(1, {"a": "1"}, [])], [(2, {"b": "2"}, []), (3, {}, ["a"])])):
        _batches(spark, rows).coalesce(1).write.mode("append").json(str(tmp_path / "feed"))
        q = M.follow(spark, str(tmp_path / "feed"), store, str(tmp_path / "cp"))
        q.awaitTermination()
    assert store.newest()[0] == 3 and [tuple(r) for r in store.newest()[1].collect()] == [("b", "2")]
    # a repeated feed from the start changes nothing
    M.follow(spark, str(tmp_path / "feed"), store, str(tmp_path / "cp2")).awaitTermination()
    assert store.newest()[0] == 3
    snap, rest = M.compact(b, 2)
    assert snap.count() == 1 and rest.count() == 1
    assert M.changes_since(b, 0, 1 << 20, 2).first().what == "reset"
    assert [r.name for r in M.orphans(spark.createDataFrame([("x",), ("y",), ("z",)], "name string"), spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([("y",)], "name string")).collect()] == ["z"]


def test_client_cursors(spark, tmp_path):
    src = str(tmp_path / "says")
    spark.createDataFrame([("a", 3), ("a", 5), ("b", 1)], "client string, seq long").coalesce(1).write.json(src)
    s = M.client_cursors(spark.readStream.schema("client string, seq long").json(src), 60_000)
    q = s.writeStream.format("memory").queryName("cursors").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("cursors").count() < 2:
            time.sleep(0.5)
        assert {(r.client, r.seq) for r in spark.table("cursors").collect()} == {("a", 5), ("b", 1)}
    finally:
        q.stop()


def test_burn_and_pandas_steps(spark):
    shapes = spark.createDataFrame([(1, 0, False, [1.0, 4.0, 4.0, 1.0, 1.0], [1.0, 1.0, 4.0, 4.0, 1.0]), (1, 1, True, [0.5, 5.5], [2.5, 2.5])], "tile int, bit int, line boolean, xs array<double>, ys array<double>")
    got = {(r.x, r.y): r.bits for r in P.burn_polygons(shapes, 6, 6).collect()}
    assert got[(1, 1)] == 1 and got[(2, 2)] == 3 and got[(0, 2)] == 2
    sk = spark.createDataFrame([([0.0, 0.5, 1.0], 8.0), ([0.25], 1.0)], "q array<double>, w double")
    assert abs(P.merge_quantile_sketches(sk, [], "q", "w", 8).agg(F.sum("weight")).first()[0] - 8) < 1e-9


def test_merged_stops_and_thinning(spark):
    from wayline.operators import corridors as C

    rows = [(1, "Main ", 0.0, 0.0), (2, "main", 700.0, 0.0), (3, "Main", 1500.0, 0.0), (4, "Other", 0.0, 0.0), (5, None, 0.0, 0.0), (6, "", 50.0, 0.0), (7, None, 500.0, 0.0), (8, "x", None, 0.0)]
    df = spark.createDataFrame(rows, "id int, name string, x double, y double")
    assert {r.id: r.stop for r in C.merge_stops(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    p = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [2]), (1, 3, [2, 3]), (2, 1, [2]), (2, 2, None)], "tile int, ord int, cells array<int>")
    assert sorted((r.tile, r.ord) for r in C.thin_pieces(p, "tile", "ord", "cells").collect()) == [(1, 1), (1, 3), (2, 1)]
    none = spark.createDataFrame([], "id int, x double, y double, heading double, hidden boolean")
    assert C.frontage(none, spark.createDataFrame([(0.0, 0.0, 9.0, 9.0)], "x0 double, y0 double, x1 double, y1 double")).count() == 0


def test_kana(spark):
    from wayline.functions.kana import romanize, romanized

    want = {"とうきょう": "Tokyo", "おおさか": "Osaka", "しんおおさか": "Shin'osaka", "ロッテ": "Rotte", "まっちゃ": "Matcha", "えいが": "Eiga", "フジ・サン": "Fuji San", "abc": None, "": None, "コーヒー": "Kohi"}
    for k, v in want.items():
        assert romanize(k) == v, k
    assert [r[0] for r in spark.createDataFrame([("とうきょう",), (None,)], "s string").select(romanized(F.col("s"))).collect()] == ["Tokyo", None]


def test_depths(spark):
    from wayline.operators import depths as D

    cells = spark.createDataFrame([(1, x, 0, w) for x, w in enumerate(["sea", "sea", "sea", "lake", None])], "tile int, x int, y int, water string")
    s = [(1, 0, 0, "fine", -5.0, 12, True, False, ["sea"]), (1, 0, 0, "coarse", -7.0, 8, True, False, ["sea"]), (1, 1, 0, "guess", -3.0, 14, False, False, ["sea"]), (1, 2, 0, "tide", 40.0, 9, True, True, ["sea"]), (1, 3, 0, "sea only", -1.0, 9, True, True, ["sea"]), (1, 4, 0, "x", -1.0, 9, True, True, ["sea", "lake"])]
    df = spark.createDataFrame(s, "tile int, x int, y int, source string, value double, zoom int, survey boolean, tidal boolean, waters array<string>")
    assert {r.x: (r.depth, r.source) for r in D.pick_depths(cells, df).collect()} == {0: (-5.0, "fine"), 1: (-3.0, "guess"), 2: (15.0, "tide")}
    t = spark.createDataFrame([(1, x, 0, x > 0, -4.0 if x == 3 else None) for x in range(4)], "tile int, x int, y int, water boolean, depth double")
    got = {r.x: r.depth for r in D.fill_depths(t, 4, 2.0).collect()}
    assert got[3] == -4.0 and got[2] is not None and got[0] is None
