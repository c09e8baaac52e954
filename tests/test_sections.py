"""Section stores, line tiles, declarations and facts; borders cut at vertices and followed as arcs."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayline.operators import network as N
from wayline.sources import line_tiles as T
from wayline.sources import sections as S


def test_sections(spark, tmp_path):
    d = str(tmp_path / "store")
    df = spark.createDataFrame([(k % 7, f"v{k}", {"a": k}) for k in range(100)], "k int, v string, m map<string,int>").repartition(5)
    S.write_sections(spark, d, {"rows": (df, ["k", "v"]), "none": (df.limit(0), ["k"])}, 3)
    s = S.Sections(spark, d, 3)
    rows = s.table("rows", check=True).orderBy("i").collect()
    assert [r.i for r in rows] == list(range(100)) and [(r.k, r.v) for r in rows] == sorted((k % 7, f"v{k}") for k in range(100))
    assert s.table("none", check=True).count() == 0 and s.table("rows", ["k"]).columns == ["i", "k"]
    assert sorted(r.i for r in s.part("rows", 95, 50).collect()) == [95, 96, 97, 98, 99]
    assert sorted(r.i for r in s.get_many("rows", spark.createDataFrame([(3,), (3,), (500,)], "i long")).collect()) == [3, 3]
    got = s.gather("rows", spark.createDataFrame([("a", 0, 2), ("b", 99, 900), ("c", 5, 5)], "ask string, first long, last long")).collect()
    assert sorted((r.ask, r.i) for r in got) == [("a", 0), ("a", 1), ("b", 99)]
    assert s.equal_range("rows", "k", 6).count() == len([k for k in range(100) if k % 7 == 6])
    with pytest.raises(ValueError):
        S.Sections(spark, d, 4)
    with pytest.raises(ValueError):
        s.table("absent")
    spark.createDataFrame([(0, "x", {"a": 1}, 7)], "k int, v string, m map<string,int>, i long").write.mode("append").parquet(f"{d}/rows")
    with pytest.raises(ValueError):
        S.Sections(spark, d, 3).table("rows", check=True)


def test_content_names(spark, tmp_path):
    a, b = (S.write_atomic(spark, str(tmp_path), x, ".bin") for x in (b"one", b"two"))
    assert a != b and S.write_atomic(spark, str(tmp_path), b"one", ".bin") == a and (tmp_path / a).read_bytes() == b"one"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted([a, b])


def test_facts_views_declarations(spark, tmp_path):
    answer = {"head": {}, "results": {"bindings": [{"item": {"type": "uri", "value": "http://x/entity/Q5"}, "label": {"type": "literal", "value": "Hall"}}, {"label": {"type": "literal", "value": "lost"}}]}}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text(json.dumps(answer))
    (tmp_path / "f" / "b.json").write_text("{broken")
    assert [tuple(r) for r in S.read_facts(spark, str(tmp_path / "f")).collect()] == [("Q5", "label", "Hall", "literal")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "pageviews-202401.txt").write_text("en A 5 x\nen A 2\nen B zz\nen C 4\n\n")
    v = S.wanted_views(S.read_pageviews(spark, str(tmp_path / "p")), spark.createDataFrame([("A",), ("Z",)], "article string"))
    assert [tuple(r) for r in v.collect()] == [("A", "202401", 7)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "r.toml").write_text('title = "x"\n[feed.one]\nurl = "u"\nn = 3\n[[list]]\na = true\n')
    (tmp_path / "d" / "t.tsv").write_text("k\tv\n# note\na\tb\n")
    got = {(r.entry, r.key, r.value) for r in S.read_declarations(spark, str(tmp_path / "d" / "*")).collect()}
    assert got == {("", "title", "x"), ("feed.one", "url", "u"), ("feed.one", "n", "3"), ("list[0]", "a", "true"), ("0", "k", "a"), ("0", "v", "b")}


def test_numbers_and_tiles(spark):
    rng = np.random.default_rng(1)
    for v in (np.array([], np.int64), np.array([0, -1, 1, 63, 64, -64, -65, (1 << 62) - 1, -(1 << 62)]), rng.integers(-(1 << 40), 1 << 40, 500), np.array([-(1 << 63), (1 << 63) - 1])):
        data = T.pack_numbers(v.astype(np.int64))
        back, at = T.unpack_numbers(np.frombuffer(data, np.uint8), len(v), 0)
        assert (back == v).all() and at == len(data)
    with pytest.raises(ValueError):
        T.unpack_numbers(np.frombuffer(b"\x80\x01\x80", np.uint8), 2, 0)
    empty = T.decode(T.encode(pd.DataFrame({"way": np.array([], np.int64), "style": np.array([], np.int64), "xs": [], "ys": [], "channels": []})))
    assert len(empty) == 0
    rows = [(3, 1, 2, 7, 40, [1, 5], [2, 2], [[0, 255]]), (3, 1, 2, 5, 8, [9, 9, 4], [1, 0, -3], [[1, 2, 3]]), (3, 1, 2, 9, 72, [3], [3], [[7]]), (3, 0, 0, 1, 1, [], [], []), (3, 0, 0, 2, 1, None, None, None)]
    back = T.decode_tiles(T.encode_tiles(spark.createDataFrame(rows, T.LINES))).orderBy("place").collect()
    assert [(r.way, r.style, list(r.xs), list(r.ys), [list(c) for c in r.channels]) for r in back] == [(r[3], r[4], r[5], r[6], r[7]) for r in (rows[2], rows[1], rows[0])]


def _ring(*pts):
    return [*pts, pts[0]]


def test_borders_meet_at_vertices_within_edges(spark):
    # the large square's right side is one edge; two small ones meet it, and each other in its middle
    rings = [("a", _ring((0, 0), (100, 0), (100, 100), (0, 100))), ("b", _ring((100, 0), (200, 0), (200, 40), (100, 40))), ("c", _ring((100, 40), (200, 40), (200, 100), (100, 100)))]
    df = spark.createDataFrame(rings, "region string, ring array<struct<lon:int,lat:int>>")
    for cell in (16, 1000):
        e = N.split_edges(df.select("region", F.explode(F.arrays_zip(F.slice("ring", 1, 4).alias("p"), F.slice("ring", 2, 4).alias("q"))).alias("e")).select("region", "e.p", "e.q"), df.select(F.explode("ring").alias("p")), cell)
        assert {((r.p.lon, r.p.lat), (r.q.lon, r.q.lat)) for r in e.where("region = 'a'").collect()} == {((0, 0), (100, 0)), ((100, 0), (100, 40)), ((100, 40), (100, 100)), ((100, 100), (0, 100)), ((0, 100), (0, 0))}
    b = N.shared_borders(df)
    inner = {(r.x0, r.y0, r.x1, r.y1): {r.left, r.right} for r in b.collect() if r.left and r.right}
    assert inner == {(100, 0, 100, 40): {"a", "b"}, (100, 40, 100, 100): {"a", "c"}, (100, 40, 200, 40): {"b", "c"}}
    arcs = N.border_arcs(b)
    got = {}
    for r in arcs.collect():
        got.setdefault(r.arc, set()).add((r.x0, r.y0, r.x1, r.y1))
    assert sorted(len(v) for v in got.values()) == [1, 1, 1, 2, 2, 3]
    lines = {tuple(r.line) for r in N.simplified_arcs(arcs, 5.0).collect()}
    assert any({x[0], x[-1]} == {"100 40", "200 40"} and len(x) == 2 for x in lines)
    ring = N.border_arcs(N.shared_borders(spark.createDataFrame([rings[0]], "region string, ring array<struct<lon:int,lat:int>>")))
    assert {r.arc for r in ring.collect()} and len({r.arc for r in ring.collect()}) == 1 and len(N.simplified_arcs(ring, 1.0).first().line) == 5
    assert N.shared_borders(df.limit(0)).count() == 0
