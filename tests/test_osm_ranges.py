"""Blobs found from any byte on: each read once, whatever the ranges; kinds taken by filters."""

import zlib

import pytest
from pyspark.sql import functions as F

from wayline.sources import osm, pmtiles, register, vector_tiles


def _field(n, kind, body):
    return vector_tiles._field(n, kind, body)


def _file(n):
    v = pmtiles.write_varint
    zz = lambda x: (x << 1) ^ (x >> 63)
    pack = lambda xs: b"".join(map(v, xs))
    out = b""
    for k in range(-1, n):
        # a text that looks like a header's mark, in a blob that is stored as it is
        texts = b"".join(_field(1, 2, s) for s in (b"", b"name", b"\x0a\x07OSMData" + b"x" * k))
        dense = _field(1, 2, pack([zz(10 + k), zz(1000)])) + _field(8, 2, pack([0, 0])) + _field(9, 2, pack([0, 0])) + _field(10, 2, pack([1, 2, 0, 0]))
        way = _field(1, 0, v(5000 + k)) + _field(8, 2, pack([zz(10), zz(2)]))
        block = _field(1, 2, texts) + _field(2, 2, _field(2, 2, dense)) + _field(2, 2, _field(3, 2, way))
        body = b"" if k < 0 else block
        blob = _field(1, 2, body) if k % 2 else _field(2, 0, v(len(body))) + _field(3, 2, zlib.compress(body))
        head = _field(1, 2, b"OSMHeader" if k < 0 else b"OSMData") + _field(3, 0, v(len(blob)))
        out += len(head).to_bytes(4, "big") + head + blob
    return out


@pytest.mark.parametrize("each", [1, 37, 200, 1 << 20])
def test_ranges(spark, tmp_path, each):
    p = str(tmp_path / "x.osm.pbf")
    (tmp_path / "x.osm.pbf").write_bytes(_file(9))
    size = len(_file(9))
    got = [b for a in range(0, size, each) for b in osm.blobs_between(p, a, a + each)]
    assert len(got) == 9 and [next(osm.rows(osm._inflate(b)))[1] for b in got] == [10 + k for k in range(9)]


def test_kinds(spark, tmp_path):
    (tmp_path / "x.osm.pbf").write_bytes(_file(5))
    register(spark)
    df = spark.read.format("osmpbf").option("bytesPerPartition", "150").load(str(tmp_path / "x.osm.pbf"))
    assert df.count() == 15 and df.where("type = 'way'").agg(F.min("id")).first()[0] == 5000
    reader = osm._Reader({"path": str(tmp_path / "x.osm.pbf")})
    assert list(reader.pushFilters([osm.EqualTo(("type",), "way"), osm.EqualTo(("id",), 5001)])) == [osm.EqualTo(("id",), 5001)]
    assert sum(b.num_rows for q in reader.partitions() for b in reader.read(q)) == 5
    (tmp_path / "empty.pbf").write_bytes(b"")
    assert spark.read.format("osmpbf").load(str(tmp_path / "empty.pbf")).count() == 0
