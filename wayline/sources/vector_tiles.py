"""Mapbox vector tiles: decode to rows, encode from rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from wayline.sources.pmtiles import _varint, write_varint

EXTENT = 4096


def _fields(b: bytes) -> Iterator[tuple[int, int, object]]:
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 0:
            v, at = _varint(b, at)
        elif kind == 1:
            v, at = b[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(b, at)
            v, at = b[at : at + n], at + n
        elif kind == 5:
            v, at = b[at : at + 4], at + 4
        else:
            raise ValueError("unknown field type")
        yield tag >> 3, kind, v


def _packed(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = _varint(b, at)
        out.append(v)
    return out


def _zig(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _value(b: bytes):
    for n, _, v in _fields(b):
        if n == 1:
            return v.decode()
        if n == 2:
            return struct.unpack("<f", v)[0]
        if n == 3:
            return struct.unpack("<d", v)[0]
        if n == 7:
            return bool(v)
        return _zig(v) if n == 6 else v
    return None


def decode(tile: bytes) -> list[dict]:
    """Features: layer, id, type (1 points, 2 lines, 3 areas), parts (lists of (x, y)), tags."""
    out = []
    for n, _, layer in _fields(tile):
        if n != 3:
            continue
        name, keys, values, feats = "", [], [], []
        for k, _, v in _fields(layer):
            if k == 1:
                name = v.decode()
            elif k == 2:
                feats.append(v)
            elif k == 3:
                keys.append(v.decode())
            elif k == 4:
                values.append(_value(v))
        for f in feats:
            row = {"layer": name, "id": None, "type": 0, "parts": [], "tags": {}}
            for k, _, v in _fields(f):
                if k == 1:
                    row["id"] = v
                elif k == 2:
                    t = _packed(v)
                    row["tags"] = {keys[a]: values[b] for a, b in zip(t[::2], t[1::2])}
                elif k == 3:
                    row["type"] = v
                elif k == 4:
                    row["parts"] = _geometry(_packed(v))
            out.append(row)
    return out


def _geometry(c: list[int]) -> list[list[tuple[int, int]]]:
    parts, x, y, at = [], 0, 0, 0
    while at < len(c):
        cmd, n = c[at] & 7, c[at] >> 3
        at += 1
        if cmd == 7:
            parts[-1].append(parts[-1][0])
            continue
        for _ in range(n):
            x, y = x + _zig(c[at]), y + _zig(c[at + 1])
            at += 2
            if cmd == 1:
                parts.append([(x, y)])
            else:
                parts[-1].append((x, y))
    return parts


def _field(n: int, kind: int, body: bytes) -> bytes:
    return write_varint(n << 3 | kind) + (write_varint(len(body)) if kind == 2 else b"") + body


def encode(features: list[dict]) -> bytes:
    """Inverse of decode(); layers in order of name, closed areas of type 3."""
    zag = lambda v: (v << 1) ^ (v >> 63)
    out = b""
    for name in sorted({f["layer"] for f in features}):
        keys: dict[str, int] = {}
        values: dict[tuple, int] = {}
        body = _field(15, 0, write_varint(2)) + _field(1, 2, name.encode())
        for f in (f for f in features if f["layer"] == name):
            tags = []
            for k in sorted(f["tags"]):
                v = f["tags"][k]
                tags += [keys.setdefault(k, len(keys)), values.setdefault((type(v).__name__, v), len(values))]
            x = y = 0
            geo = []
            for part in f["parts"]:
                pts = part[:-1] if f["type"] == 3 and len(part) > 1 and part[0] == part[-1] else part
                for i, (px, py) in enumerate(pts):
                    if i == 0:
                        geo.append(1 | 1 << 3)
                    elif i == 1:
                        geo.append(2 | (len(pts) - 1) << 3)
                    geo += [zag(px - x), zag(py - y)]
                    x, y = px, py
                if f["type"] == 3:
                    geo.append(7 | 1 << 3)
            one = b"" if f["id"] is None else _field(1, 0, write_varint(f["id"]))
            one += _field(2, 2, b"".join(map(write_varint, tags))) + _field(3, 0, write_varint(f["type"])) + _field(4, 2, b"".join(map(write_varint, geo)))
            body += _field(2, 2, one)
        for k in keys:
            body += _field(3, 2, k.encode())
        for kind, v in values:
            if kind == "str":
                one = _field(1, 2, v.encode())
            elif kind == "bool":
                one = _field(7, 0, write_varint(int(v)))
            elif kind == "int":
                one = _field(6, 0, write_varint(zag(v)))
            else:
                one = _field(3, 1, struct.pack("<d", v))
            body += _field(4, 2, one)
        out += _field(3, 2, body + _field(5, 0, write_varint(EXTENT)))
    return out


def read_tiles(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, id, type, parts, tags) of tiles (z, x, y, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.z, r.x, r.y, f["layer"], f["id"], f["type"], [[{"x": a, "y": b} for a, b in p] for p in f["parts"]], {k: str(v) for k, v in f["tags"].items()}) for r in pdf.itertuples() for f in decode(r.data)]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "id", "type", "parts", "tags"])

    return tiles.mapInPandas(run, "z int, x int, y int, layer string, id long, type int, parts array<array<struct<x int, y int>>>, tags map<string,string>")


def write_point_tiles(points: DataFrame) -> DataFrame:
    """(z, x, y, data): points (z, x, y, layer, id, px, py, name; px and py in the tile's 4,096 units) as vector tiles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["layer", "id"])
        feats = [{"layer": r.layer, "id": int(r.id), "type": 1, "parts": [[(int(r.px), int(r.py))]], "tags": {"name": r.name_} if r.name_ else {}} for r in pdf.rename(columns={"name": "name_"}).itertuples()]
        return pd.DataFrame([(pdf["z"].iloc[0], pdf["x"].iloc[0], pdf["y"].iloc[0], encode(feats))], columns=["z", "x", "y", "data"])

    return points.groupBy("z", "x", "y").applyInPandas(run, "z int, x int, y int, data binary")
