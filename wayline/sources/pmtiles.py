"""PMTiles version 3 archives as a Spark data source: ``spark.read.format("pmtiles").load(path)``.

One partition per stretch of the root directory, so leaves are read by the tasks.  Columns: z, x, y, data (decompressed where gzip).
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayline.sources.files import open_file

HEADER = 127


def zxy_to_id(z: int, x: int, y: int) -> int:
    """Place of a tile on the Hilbert curve, after all lower zooms."""
    base = ((1 << (2 * z)) - 1) // 3
    d, s, n = 0, (1 << z) >> 1, 1 << z
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if ry == 0:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return base + d


def id_to_zxy(i: int) -> tuple[int, int, int]:
    z = 0
    while i >= 1 << (2 * z):
        i -= 1 << (2 * z)
        z += 1
    x = y = 0
    s = 1
    while s < 1 << z:
        rx = 1 & (i // 2)
        ry = 1 & (i ^ rx)
        if ry == 0:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
        i //= 4
        s *= 2
    return z, x, y


def _varint(b: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        c = b[at]
        at += 1
        v |= (c & 127) << shift
        if c < 128:
            return v, at
        shift += 7


def write_varint(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def parse_directory(b: bytes) -> list[tuple[int, int, int, int]]:
    """(tile id, run length, offset, length); run length 0 points to a leaf."""
    n, at = _varint(b, 0)
    cols = []
    for _ in range(4):
        col = []
        for _ in range(n):
            v, at = _varint(b, at)
            col.append(v)
        cols.append(col)
    ids, out, last = 0, [], (0, 0)
    for k in range(n):
        ids += cols[0][k]
        off = cols[3][k] - 1 if cols[3][k] else last[0] + last[1]
        last = (off, cols[2][k])
        out.append((ids, cols[1][k], off, cols[2][k]))
    return out


def write_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    out = [write_varint(len(entries))]
    out += [write_varint(e[0] - p) for e, p in zip(entries, [0, *[e[0] for e in entries[:-1]]])]
    out += [write_varint(e[1]) for e in entries] + [write_varint(e[3]) for e in entries] + [write_varint(e[2] + 1) for e in entries]
    return b"".join(out)


def _header(path: str) -> dict:
    with open_file(path) as f:
        h = f.read(HEADER)
    if h[:7] != b"PMTiles" or h[7] != 3:
        raise ValueError(f"{path} is no PMTiles version 3 archive")
    u = lambda k: int.from_bytes(h[8 + 8 * k : 16 + 8 * k], "little")
    return {"root": (u(0), u(1)), "leaf": u(4), "data": u(6), "internal": h[97], "tile": h[98]}


def _read(f, at: int, n: int, compression: int) -> bytes:
    f.seek(at)
    b = f.read(n)
    return gzip.decompress(b) if compression == 2 else b


def write_archive(path: str, tiles: dict[tuple[int, int, int], bytes]) -> None:
    """A small uncompressed archive with one directory; equal tiles are stored once."""
    at, blobs, entries, seen = 0, [], [], {}
    for i, data in sorted((zxy_to_id(*k), v) for k, v in tiles.items()):
        if data not in seen:
            seen[data] = at
            blobs.append(data)
            at += len(data)
        if entries and entries[-1][2] == seen[data] and entries[-1][0] + entries[-1][1] == i:
            entries[-1] = (entries[-1][0], entries[-1][1] + 1, *entries[-1][2:])
        else:
            entries.append((i, 1, seen[data], len(data)))
    root = write_directory(entries)
    h = bytearray(HEADER)
    h[:8] = b"PMTiles\x03"
    for k, v in enumerate((HEADER, len(root), HEADER + len(root), 0, HEADER + len(root), 0, HEADER + len(root), at, len(tiles), len(entries), len(blobs))):
        h[8 + 8 * k : 16 + 8 * k] = v.to_bytes(8, "little")
    h[96:100] = bytes([1, 1, 1, 0])
    with open(path, "wb") as f:
        f.write(bytes(h) + root + b"".join(blobs))


class _Part(InputPartition):
    def __init__(self, entries):
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"], int(options.get("partitions", "8"))

    def partitions(self):
        h = _header(self.path)
        with open_file(self.path) as f:
            root = parse_directory(_read(f, *h["root"], h["internal"]))
        n = max(1, -(-len(root) // self.parts))
        return [_Part(root[i : i + n]) for i in range(0, len(root), n)] or [_Part([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        h = _header(self.path)
        with open_file(self.path) as f:
            todo = list(partition.entries)
            while todo:
                i, run, off, n = todo.pop(0)
                if run == 0:
                    todo = parse_directory(_read(f, h["leaf"] + off, n, h["internal"])) + todo
                    continue
                data = _read(f, h["data"] + off, n, h["tile"])
                for first in range(i, i + run, 4096):
                    zxy = list(zip(*(id_to_zxy(k) for k in range(first, min(first + 4096, i + run)))))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in zxy), pa.array([data] * len(zxy[0]), pa.binary())], ["z", "x", "y", "data"])


class PmtilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return "z int, x int, y int, data binary"

    def reader(self, schema):
        return _Reader(self.options)
