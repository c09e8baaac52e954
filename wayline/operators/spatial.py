"""Points near points and points in regions by hashed grid cells.

Cells are latitude bands twice as high as the radius, each cut into as many equal longitude
cells as fit, so cells keep their size up to the poles and wrap at the date line.  One
side is sent to the cells that its circle can touch (a little over two on average), the other
to its own cell; an equi-join on the cell and an exact test follow.  Regions are cut into the cells of a grid once: cells
that lie inside need no test of the outline, cells on the outline only its pieces in their band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean earth radius in metres (fixed value).
EARTH_M = 6_371_008.8


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres of points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def position(lon: Column, lat: Column) -> Column:
    """struct(lon, lat), longitude wrapped to [-180, 180); null where it is no position: missing, NaN,
    exactly (0, 0), or a latitude beyond 90."""
    ok = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lat) <= 90) & (F.abs(lon) < 1e6) & ~((lon == 0) & (lat == 0))
    return F.when(ok, F.struct((F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("lon"), lat.alias("lat")))


#: Height of a cell in radii: circles then touch few cells, and the cells they touch are no larger in sum than with cells of one radius.
CELL_RADII = 2.0


def _degrees(radius_m: float) -> float:
    return min(180.0, math.degrees(radius_m / EARTH_M) * (1 + 1e-9) + 1e-9)


def _cells_in_band(band: Column, high: float) -> Column:
    south, north = band * high - 90.0, (band + 1) * high - 90.0
    flattest = F.when((south <= 0) & (north >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north)))
    return F.greatest(F.lit(1), F.floor(360.0 / high * F.cos(F.radians(flattest)))).cast("long")


def own_cell(lon: Column, lat: Column, radius_m: float) -> Column:
    high = min(180.0, CELL_RADII * _degrees(radius_m))
    band = F.floor((lat + 90.0) / high)
    n = _cells_in_band(band, high)
    cell = F.pmod(F.floor((lon + 180.0) * n / 360.0), n)
    return band * F.lit(1 << 32) + cell


def touched_cells(lon: Column, lat: Column, radius_m: float) -> Column:
    """Array of the cells that a circle of ``radius_m`` round the point can reach."""
    near = _degrees(radius_m)
    high = min(180.0, CELL_RADII * near)
    angle = math.radians(near)
    wide = F.when(F.abs(lat) + near >= 90.0, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(angle) / F.cos(F.radians(lat))))) + 1e-9)
    bands = F.sequence(F.greatest(F.floor((lat - near + 90.0) / high), F.lit(0)), F.floor((lat + near + 90.0) / high))

    def of(band: Column) -> Column:
        n = _cells_in_band(band, high)
        lo, hi = F.floor((lon - wide + 180.0) * n / 360.0), F.floor((lon + wide + 180.0) * n / 360.0)
        span = F.when(hi - lo + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(lo, hi))
        return F.transform(span, lambda x: band * F.lit(1 << 32) + F.pmod(x, n))

    return F.flatten(F.transform(bands, of))


def _points(df: DataFrame, name: str) -> DataFrame:
    """(name_id, name, several): each id's positions, and whether it has more than one."""
    x = df.where("id is not null and pos is not null").groupBy(F.col("id").alias(f"{name}_id")).agg(F.collect_set("pos").alias("all"))
    return x.select(f"{name}_id", F.explode("all").alias(name), (F.size("all") > 1).alias(f"{name}_several"))


def within_distance(a: DataFrame, b: DataFrame, radius_m: float) -> DataFrame:
    """(a_id, b_id, metres): pairs at most ``radius_m`` apart.

    ``a`` and ``b`` have id and pos, as from position(); rows without id or pos are left out and repeated
    rows count once; of an id with several positions the nearest counts.  A pair of positions meets in one cell only, so only the pairs of ids with
    several positions are brought together again.  Crowded cells are split by the skew join of adaptive execution.
    """
    x = _points(a, "a").withColumn("cell", F.explode(F.array_distinct(touched_cells(F.col("a.lon"), F.col("a.lat"), radius_m))))
    y = _points(b, "b").withColumn("cell", own_cell(F.col("b.lon"), F.col("b.lat"), radius_m))
    d = haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    pairs = x.join(y, "cell").withColumn("metres", d).where(F.col("metres") <= radius_m)
    near = pairs.withColumn("one", F.when(F.col("a_several") | F.col("b_several"), F.lit(None).cast("double")).otherwise(F.col("metres")))
    once = near.where("one is not null").select("a_id", "b_id", "metres")
    return once.unionByName(near.where("one is null").groupBy("a_id", "b_id").agg(F.min("metres").alias("metres")))


def ring_holds(ring: str, lon: str, lat: str) -> Column:
    """Even-odd test of a closed ring (array of struct lon, lat)."""
    return F.expr(
        f"aggregate(sequence(0, size({ring}) - 2), false, (inside, i) -> "
        f"if(({ring}[i].lat > {lat}) <> ({ring}[i + 1].lat > {lat}) and {lon} < ({ring}[i + 1].lon - {ring}[i].lon) * ({lat} - {ring}[i].lat) / ({ring}[i + 1].lat - {ring}[i].lat) + {ring}[i].lon, not inside, inside))"
    )


CELLS_DDL = "cx long, cy long, edges array<struct<x0 double, y0 double, x1 double, y1 double>>"


def ring_cells(xs: np.ndarray, ys: np.ndarray, cell_deg: float) -> Iterator[tuple[int, int, list[dict] | None]]:
    """The grid cells of a closed ring (even-odd): (cx, cy, None) for those inside, (cx, cy, edges of the ring in the cell's band) for those on it."""
    x0, y0, x1, y1 = xs[:-1], ys[:-1], xs[1:], ys[1:]
    lo, hi = np.floor(np.minimum(y0, y1) / cell_deg), np.floor(np.maximum(y0, y1) / cell_deg)
    for cy in range(int(lo.min()), int(hi.max()) + 1):
        m = np.flatnonzero((lo <= cy) & (hi >= cy))
        if not len(m):
            continue
        a, b, c, d = x0[m], y0[m], x1[m], y1[m]
        # the part of each edge within the band, and the cells it runs through
        flat = b == d
        rise = np.where(flat, 1.0, d - b)
        t = np.clip(np.array([(cy * cell_deg - b) / rise, ((cy + 1) * cell_deg - b) / rise]), 0.0, 1.0)
        t[0, flat], t[1, flat] = 0.0, 1.0
        px = a + t * (c - a)
        first, last = np.floor(px.min(0) / cell_deg - 1e-9).astype(int), np.floor(px.max(0) / cell_deg + 1e-9).astype(int)
        west = int(first.min())
        on = np.zeros(int(last.max()) - west + 1, bool)
        for i, j in zip(first - west, last - west):
            on[i : j + 1] = True
        mid = (cy + 0.5) * cell_deg
        k = (b > mid) != (d > mid)
        cross = np.sort((c[k] - a[k]) * (mid - b[k]) / (d[k] - b[k]) + a[k])
        centre = (np.arange(len(on)) + west + 0.5) * cell_deg
        inside = (len(cross) - np.searchsorted(cross, centre, "right")) % 2 == 1
        edges = [{"x0": p, "y0": q, "x1": r, "y1": s} for p, q, r, s in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())]
        for i in np.flatnonzero(on | inside):
            yield west + int(i), cy, edges if on[i] else None


def _cut_rings(cell_deg: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for region, ring in zip(pdf["region"], pdf["ring"]):
                pts = np.array([(q["lon"], q["lat"]) for q in ring if q is not None and q["lon"] is not None and q["lat"] is not None], float)
                if len(pts) < 4:
                    continue
                rows = list(ring_cells(pts[:, 0], pts[:, 1], cell_deg))
                for at in range(0, len(rows), 2048):
                    part = rows[at : at + 2048]
                    yield pd.DataFrame({"region": region, "cx": [r[0] for r in part], "cy": [r[1] for r in part], "edges": [r[2] for r in part]})

    return run


def region_of(points: DataFrame, regions: DataFrame, cell_deg: float = 0.5) -> DataFrame:
    """(id, region): the regions that hold each point.

    ``points`` has id and pos, ``regions`` region and ring (closed).  Each ring is cut into grid cells once: a point in a cell inside the ring is
    held without a test, one in a cell on the ring is tested against the ring's edges in the cell's band.  Regions and points may both grow; a
    crowded cell has few regions and is split by the skew join of adaptive execution.  Rings of fewer than four points hold nothing.
    """
    p = points.where("id is not null and pos is not null").select("id", "pos.lon", "pos.lat").distinct()
    p = p.withColumn("cx", F.floor(F.col("lon") / cell_deg)).withColumn("cy", F.floor(F.col("lat") / cell_deg))
    r = regions.where("region is not null and size(ring) >= 4").select("region", "ring")
    r = r.mapInPandas(_cut_rings(cell_deg), f"region {regions.schema['region'].dataType.simpleString()}, {CELLS_DDL}")
    crosses = lambda e: ((e["y0"] > F.col("lat")) != (e["y1"] > F.col("lat"))) & (F.col("lon") < (e["x1"] - e["x0"]) * (F.col("lat") - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])
    hit = p.join(r, ["cx", "cy"]).where(F.col("edges").isNull() | (F.size(F.filter("edges", crosses)) % 2 == 1))
    return hit.select("id", "region").distinct()
