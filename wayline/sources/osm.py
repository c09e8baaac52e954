"""OpenStreetMap PBF files as a Spark data source: ``spark.read.format("osmpbf").load(path)``.

A partition is a range of bytes and reads the blobs that begin in it, so the file is never walked through beforehand; nodes, ways and relations come as
rows of one schema, in Arrow batches, and are selected by ``type``, so that the passes of a set (routes, their ways, their nodes) are joins.  Tests on ``type`` reach
the reader where the session lets Python sources take filters.  The path may be on any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from wayline.sources.files import open_file

from wayline.sources.vector_tiles import _fields, _packed, _zig

SCHEMA = "type string, id long, lon int, lat int, tags map<string,string>, refs array<long>, roles array<string>, kinds array<string>"
KINDS = ["node", "way", "relation"]
ARROW = pa.schema([
    ("type", pa.string()), ("id", pa.int64()), ("lon", pa.int32()), ("lat", pa.int32()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())),
])


#: Bytes of a partition, and the most that a blob's header has by the format.
RANGE, HEADER = 64 << 20, 64 << 10
_MARK = b"\x0a\x07OSMData"


def blobs(path: str) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every blob."""
    out = []
    with open_file(path) as f:
        while len(n := f.read(4)) == 4:
            head = {k: v for k, _, v in _fields(f.read(int.from_bytes(n, "big")))}
            size = head[3]
            out.append((f.tell(), size, head[1].decode()))
            f.seek(f.tell() + size)
    return out


def _head(f, at: int, end: int) -> tuple[int, int, str] | None:
    """Begin and length of the blob whose header is at ``at``, and its type; None if there is no header."""
    f.seek(at)
    n = int.from_bytes(f.read(4), "big")
    if not 0 < n <= HEADER:
        return None
    raw = f.read(n)
    try:
        head = {k: v for k, _, v in _fields(raw)}
        kind, size = head[1].decode(), head[3]
    except (KeyError, IndexError, ValueError, AttributeError, UnicodeDecodeError):
        return None
    return (at + 4 + n, size, kind) if kind in ("OSMData", "OSMHeader") and at + 4 + n + size <= end else None


def first_header(f, start: int, end: int) -> int:
    """Where the first header at or after ``start`` is, ``end`` without one: a data blob's mark whose header, and the one that follows, can be read."""
    if start == 0:
        return 0
    at, step = start, 1 << 20
    while at < end:
        f.seek(at)
        window = f.read(step + len(_MARK) + 4)
        k = window.find(_MARK)
        while k >= 0:
            spot = at + k - 4
            if spot >= start and (head := _head(f, spot, end)) and (head[0] + head[1] == end or _head(f, head[0] + head[1], end)):
                return spot
            k = window.find(_MARK, k + 1)
        at += step
    return end


def blobs_between(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The data blobs whose headers begin in a range of bytes."""
    with open_file(path) as f:
        end = f.size()
        # a mark may lie up to four bytes after its header's begin
        at = first_header(f, start, end)
        while at < min(stop, end):
            head = _head(f, at, end)
            if head is None:
                raise ValueError(f"no blob at {at} of {path}")
            if head[2] == "OSMData":
                f.seek(head[0])
                yield f.read(head[1])
            at = head[0] + head[1]


def _inflate(blob: bytes) -> bytes:
    got = {k: v for k, _, v in _fields(blob)}
    if 1 in got:
        return got[1]
    if 3 in got:
        return zlib.decompress(got[3])
    raise ValueError("only raw and zlib blobs are read")


def _sums(values: list[int]) -> list[int]:
    out, now = [], 0
    for v in values:
        now += _zig(v)
        out.append(now)
    return out


def rows(block: bytes, kinds: tuple[str, ...] = ("node", "way", "relation")) -> Iterator[tuple]:
    """Rows of a primitive block, of some kinds."""
    texts, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for k, _, v in _fields(block):
        if k == 1:
            texts = [s.decode("utf-8", "replace") for n, _, s in _fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            lat0 = v
        elif k == 20:
            lon0 = v
    e7 = lambda v, base: (base + grain * v) // 100
    for g in groups:
        for k, _, v in _fields(g):
            if {1: "node", 2: "node", 3: "way", 4: "relation"}.get(k) not in kinds:
                continue
            if k == 2:
                d = {n: x for n, _, x in _fields(v)}
                ids, lats, lons, kv = _sums(_packed(d[1])), _sums(_packed(d[8])), _sums(_packed(d[9])), _packed(d.get(10, b""))
                at = 0
                for i, la, lo in zip(ids, lats, lons):
                    tags = {}
                    while at < len(kv) and kv[at]:
                        tags[texts[kv[at]]] = texts[kv[at + 1]]
                        at += 2
                    at += 1
                    yield ("node", i, e7(lo, lon0), e7(la, lat0), tags, None, None, None)
            elif k == 1:
                d = {n: x for n, _, x in _fields(v)}
                yield ("node", _zig(d[1]), e7(_zig(d[9]), lon0), e7(_zig(d[8]), lat0), _tags(d, texts), None, None, None)
            elif k == 3:
                d = {n: x for n, _, x in _fields(v)}
                yield ("way", d[1], None, None, _tags(d, texts), _sums(_packed(d.get(8, b""))), None, None)
            elif k == 4:
                d = {n: x for n, _, x in _fields(v)}
                yield ("relation", d[1], None, None, _tags(d, texts), _sums(_packed(d.get(9, b""))), [texts[r] for r in _packed(d.get(8, b""))], [KINDS[t] for t in _packed(d.get(10, b""))])


def _tags(d: dict, texts: list[str]) -> dict[str, str]:
    return {texts[a]: texts[b] for a, b in zip(_packed(d.get(2, b"")), _packed(d.get(3, b"")))}


class _Part(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.each, self.kinds = options["path"], int(options.get("bytesPerPartition", str(RANGE))), tuple(KINDS)

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("type",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = tuple(k for k in self.kinds if k in wanted)
            else:
                yield f

    def partitions(self):
        with open_file(self.path) as f:
            size = f.size()
        return [_Part(a, a + self.each) for a in range(0, max(size, 1), self.each)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for blob in blobs_between(self.path, partition.start, partition.stop):
            got = list(rows(_inflate(blob), self.kinds))
            for i in range(0, len(got), 8192):
                cols = list(zip(*got[i : i + 8192]))
                cols[4] = [list(t.items()) for t in cols[4]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)


class OsmPbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
