"""Lines of map tiles as one binary column: whole numbers in differences, seven bits a byte, column by column.

A tile holds its lines in draw order.  First the number of lines; then, each as a column over all lines or points: ways, styles, numbers of points, x, y and the
channels.  Differences run from point to point and from line to line, so neighbours cost a byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.details import draw_order

LINES = "z int, x int, y int, way long, style int, xs array<int>, ys array<int>, channels array<array<int>>"


def pack_numbers(v: np.ndarray) -> bytes:
    """Signed whole numbers, small ones short."""
    u = ((v << 1) ^ (v >> 63)).astype(np.uint64)
    length = np.ones(len(u), np.int64)
    for k in range(1, 10):
        length += u >= np.uint64(1) << np.uint64(7 * k)
    out = np.zeros(int(length.sum()), np.uint8)
    at = np.cumsum(length) - length
    for k in range(int(length.max(initial=0))):
        m = length > k
        out[at[m] + k] = ((u[m] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(length[m] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpack_numbers(data: np.ndarray, n: int, at: int) -> tuple[np.ndarray, int]:
    """``n`` numbers from ``at`` on, and where they end; ValueError if there are fewer."""
    if n == 0:
        return np.zeros(0, np.int64), at
    ends = np.flatnonzero(data[at:] < 128)[:n]
    if len(ends) < n:
        raise ValueError("the tile ends too early")
    starts = np.append(0, ends[:-1] + 1)
    u = np.zeros(n, np.uint64)
    for k in range(int((ends - starts).max()) + 1):
        m = starts + k <= ends
        u[m] |= (data[at + starts[m] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64), at + int(ends[-1]) + 1


def encode(lines: pd.DataFrame) -> bytes:
    """One tile's lines (way, style, xs, ys, channels) in their order; lines may differ in points, not in the number of channels."""
    n = np.array([len(v) for v in lines["xs"]], np.int64)
    depth = max((len(c) for c in lines["channels"]), default=0)
    join = lambda parts: np.concatenate([np.asarray(p, np.int64) for p in parts]) if len(n) else np.zeros(0, np.int64)
    cols = [lines["way"].to_numpy(np.int64), lines["style"].to_numpy(np.int64), n, join(lines["xs"]), join(lines["ys"])] + [join([c[k] for c in lines["channels"]]) for k in range(depth)]
    head = pack_numbers(np.array([len(n), depth], np.int64))
    return head + b"".join(pack_numbers(c if i in (1, 2) else np.diff(c, prepend=0)) for i, c in enumerate(cols))


def decode(data: bytes) -> pd.DataFrame:
    buf = np.frombuffer(data, np.uint8)
    (count, depth), at = unpack_numbers(buf, 2, 0)
    cols = []
    for i in range(3):
        c, at = unpack_numbers(buf, int(count), at)
        cols.append(c if i else np.cumsum(c))
    way, style, n = cols
    points = []
    for _ in range(2 + int(depth)):
        c, at = unpack_numbers(buf, int(n.sum()), at)
        points.append(np.split(np.cumsum(c).astype(np.int32), np.cumsum(n)[:-1]) if count else [])
    channels = [[points[2 + k][i] for k in range(int(depth))] for i in range(int(count))]
    return pd.DataFrame({"way": way, "style": style.astype(np.int32), "xs": points[0], "ys": points[1], "channels": channels})


def encode_tiles(lines: DataFrame) -> DataFrame:
    """(z, x, y, data) of LINES, each tile's in draw order.  A tile holds what is drawn in it."""
    first = F.get("xs", F.lit(0)), F.get("ys", F.lit(0))
    x = lines.where("size(xs) > 0 and size(xs) = size(ys)").withColumn("tile", F.struct("z", "x", "y")).withColumns({"x0": first[0], "y0": first[1]})
    x = draw_order(x, "tile", "style", "way", "x0", "y0", "way").select("z", "x", "y", "way", "style", "xs", "ys", "channels", "place")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        return pd.DataFrame({"z": [pdf["z"].iloc[0]], "x": [pdf["x"].iloc[0]], "y": [pdf["y"].iloc[0]], "data": [encode(pdf)]})

    return x.groupBy("z", "x", "y").applyInPandas(run, "z int, x int, y int, data binary")


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """LINES of (z, x, y, data) with their place in the tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                got = decode(r.data)
                yield pd.DataFrame({"z": r.z, "x": r.x, "y": r.y, "way": got["way"], "style": got["style"], "xs": got["xs"], "ys": got["ys"], "channels": got["channels"], "place": np.arange(len(got), dtype=np.int32)})

    return tiles.select("z", "x", "y", "data").mapInPandas(run, f"{LINES}, place int")
