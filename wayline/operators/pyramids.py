"""Roll-ups over zoom levels, weighted distributions, sketches, building heights, raster steps by tile."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import cut


def _up(c: str) -> Column:
    return F.floor(F.col(c) / 2).alias(c)


def mean_levels(cells: DataFrame, value: str, levels: int) -> DataFrame:
    """(level, x, y, value): the mean of the known children of each cell, level by level (0: the cells themselves)."""
    now = cells.select("x", "y", F.col(value).cast("double").alias("value")).where("value is not null")
    out = now.select(F.lit(0).alias("level"), "x", "y", "value")
    for k in range(1, levels + 1):
        now = now.groupBy(_up("x"), _up("y")).agg(F.avg("value").alias("value"))
        out = out.unionByName(now.select(F.lit(k).alias("level"), "x", "y", "value"))
    return out


def majority_levels(cells: DataFrame, value: str, levels: int, first: int | None = None) -> DataFrame:
    """(level, x, y, value): the most frequent class of the children; ``first`` wins with half of the known ones; ties go to the smaller class."""
    now = cells.select("x", "y", F.col(value).alias("value")).where("value is not null")
    out = now.select(F.lit(0).alias("level"), "x", "y", "value")
    for k in range(1, levels + 1):
        n = now.groupBy(_up("x"), _up("y"), "value").agg(F.count("*").alias("n"))
        g = n.groupBy("x", "y").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("most"), F.sum("n").alias("all"), F.sum(F.when(F.col("value") == first, F.col("n")) if first is not None else F.lit(None).cast("long")).alias("first"))
        now = g.select("x", "y", F.when(F.coalesce("first", F.lit(0)) * 2 >= F.col("all"), F.lit(first)).otherwise(F.col("most")).alias("value") if first is not None else F.col("most").alias("value"))
        out = out.unionByName(now.select(F.lit(k).alias("level"), "x", "y", "value"))
    return out


def union_levels(cells: DataFrame, sets: str, levels: int) -> DataFrame:
    """(level, x, y, value): the union of the children's sets, as sorted arrays."""
    now = cells.select("x", "y", F.explode(sets).alias("v")).distinct()
    out = None
    for k in range(levels + 1):
        if k:
            now = now.select(_up("x"), _up("y"), "v").distinct()
        level = now.groupBy("x", "y").agg(F.array_sort(F.collect_set("v")).alias("value")).select(F.lit(k).alias("level"), "x", "y", "value")
        out = level if out is None else out.unionByName(level)
    return out


def bands(df: DataFrame, value: Column, weight: Column, width: float, most: int, by: list[str]) -> DataFrame:
    """(by, band, weight): weights by band of value; below 0 in the first, beyond ``most`` in the last."""
    b = F.least(F.floor(F.greatest(value / width, F.lit(0.0))), F.lit(most)).cast("int")
    return df.groupBy(*by, b.alias("band")).agg(F.sum(weight).alias("weight"))


def weighted_quantiles(df: DataFrame, value: str, weight: str, by: list[str], shares: list[float]) -> DataFrame:
    """(by, share, value): the least value at which the running weight reaches each share of the group's.

    Values are added up first; running weights go over buckets of value and then within a bucket, so a group may be of any size."""
    n = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    span = n.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("total"))
    x = n.join(span, by) if by else n.withColumn("__one", F.lit(1)).join(span.withColumn("__one", F.lit(1)), "__one").drop("__one")
    x = x.withColumn("b", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256)).otherwise(0))
    sums = x.groupBy(*by, "b").agg(F.sum("w").alias("bw"))
    sums = sums.withColumn("before", F.coalesce(F.sum("bw").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bw")
    x = x.join(sums, [*by, "b"]).withColumn("to", F.col("before") + F.sum("w").over(Window.partitionBy(*by, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    asks = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return x.select(*by, "v", "to", "total", asks).where(F.col("to") >= F.col("share") * F.col("total")).groupBy(*by, "share").agg(F.min("v").alias("value"))


def merge_quantile_sketches(sketches: DataFrame, by: list[str], quantiles: str, weight: str, bins: int = 2048) -> DataFrame:
    """(by, bin, weight): sketches (equally spaced quantiles of a weight) merged: each interval's weight is spread over the bins between its ends (values 0 to 1)."""
    x = sketches.select(*by, F.col(weight).alias("w"), F.size(quantiles).alias("n"), F.posexplode(F.arrays_zip(F.slice(quantiles, 1, F.size(quantiles) - 1).alias("a"), F.slice(quantiles, F.lit(2), F.size(quantiles) - 1).alias("b"))).alias("i", "q")).where("n > 1")
    a, b = F.floor(F.least(F.col("q.a"), F.lit(1.0 - 1e-12)) * bins), F.floor(F.least(F.col("q.b"), F.lit(1.0 - 1e-12)) * bins)
    x = x.select(*by, (F.col("w") / (F.col("n") - 1) / (b - a + 1)).alias("w"), F.explode(F.sequence(a, b)).alias("bin"))
    return x.groupBy(*by, "bin").agg(F.sum("w").alias("weight"))


def fill_heights(b: DataFrame, storey: Column, allowance: Column, sizes: Column) -> DataFrame:
    """Adds height_dm and rule: measured, floors, estimate, neighbours (column near_dm), built-height cell, size.

    b: h_dm (0 none), est boolean, floors (0 none), near_dm, cell_dm, area, size_class 0..4; ``sizes``: array of metres by size class."""
    dm = lambda m: F.least(F.greatest(F.round(m * 10), F.lit(0)), F.lit(65535)).cast("int")
    taken = F.col("h_dm").between(20, 7000)
    by = F.when(taken & ~F.col("est"), "measured").when(F.col("floors").between(1, 120), "floors").when(taken, "estimate").when(F.col("near_dm").isNotNull(), "neighbours").when(F.col("cell_dm") >= 150, "cell").otherwise("size")
    x = b.withColumn("rule", by)
    floors = dm(F.least(F.greatest(storey * F.col("floors") + allowance, F.lit(2.0)), F.lit(700.0)))
    small = F.when(F.col("area") < 200, F.least(F.col("cell_dm"), F.lit(250))).otherwise(F.col("cell_dm"))
    h = F.when(F.col("rule").isin("measured", "estimate"), F.col("h_dm")).when(F.col("rule") == "floors", floors).when(F.col("rule") == "neighbours", F.col("near_dm")).when(F.col("rule") == "cell", small).otherwise(dm(F.get(sizes, F.col("size_class"))))
    return x.withColumn("height_dm", h.cast("int"))


def neighbour_heights(open_: DataFrame, known: DataFrame) -> DataFrame:
    """(id, near_dm): the lower median height of known buildings within 150 m of half to twice the footprint (five or more), else, for an
    asked one of at least 60 m², of all known ones within 300 m (eight or more).  Both: id (unique), x, y (metres), area; known: h.

    Places are paired, not buildings: what stands on one place is counted by footprint and height first, and asked once per footprint."""
    cell = lambda c: F.floor(F.col(c) / 300.0)
    k = known.groupBy(F.col("x").alias("kx"), F.col("y").alias("ky"), F.col("area").alias("karea"), "h").agg(F.count("*").alias("n"))
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    o = open_.select("x", "y").distinct().select("x", "y", around.alias("c")).select("x", "y", "c.cx", "c.cy")
    at = known.select(F.col("x").alias("kx"), F.col("y").alias("ky")).distinct().select("kx", "ky", cell("kx").alias("cx"), cell("ky").alias("cy"))
    d = F.hypot(F.col("x") - F.col("kx"), F.col("y") - F.col("ky"))
    places = o.join(at, ["cx", "cy"]).select("x", "y", "kx", "ky", d.alias("d")).where("d <= 300")
    # heights are whole decimetres: counting them keeps a crowd of neighbours as a few rows
    n = places.join(k, ["kx", "ky"]).groupBy("x", "y", "karea", "h").agg(F.sum(F.when(F.col("d") <= 150, F.col("n"))).alias("a"), F.sum("n").alias("b"))
    n = cut(n)
    far = _lower_median(n.groupBy("x", "y", "h").agg(F.sum("b").alias("n")), ["x", "y"], 8, "far")
    asked = open_.select("x", "y", "area").distinct()
    alike = asked.join(n.where("a is not null").select("x", "y", "karea", "h", "a"), ["x", "y"]).where(F.col("karea").between(F.col("area") * 0.5, F.col("area") * 2))
    near = _lower_median(alike.groupBy("x", "y", "area", "h").agg(F.sum("a").alias("n")), ["x", "y", "area"], 5, "near")
    pick = asked.join(far, ["x", "y"]).join(near, ["x", "y", "area"], "left").select("x", "y", "area", F.coalesce("near", F.when(F.col("area") >= 60, F.col("far"))).alias("near_dm"))
    return open_.select("id", "x", "y", "area").join(pick, ["x", "y", "area"]).select("id", "near_dm")


def _lower_median(counts: DataFrame, by: list[str], least: int, name: str) -> DataFrame:
    """(by, name): the lower median of h by its counts (by, h, n), null where there are fewer than ``least``."""
    w = Window.partitionBy(*by)
    x = counts.withColumns({"total": F.sum("n").over(w), "to": F.sum("n").over(w.orderBy("h").rowsBetween(Window.unboundedPreceding, 0))})
    return x.groupBy(*by).agg(F.min(F.when((F.col("total") >= least) & (F.col("to") >= F.floor((F.col("total") - 1) / 2) + 1), F.col("h"))).alias(name))


def row_runs(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, x0, x1): set cells of each row as runs; x1 is the last cell."""
    from wayline.operators.sequences import value_runs

    return value_runs(cells, [*by, "y"], "x").select(*by, "y", F.col("first").alias("x0"), F.col("last").alias("x1"))


def per_tile(cells: DataFrame, by: list[str], value: str, size: int, run: Callable[[np.ndarray], dict]) -> DataFrame:
    """A numpy step per tile: cells (by, x, y in 0..size-1, value) as an array with NaN for the missing ones; ``run`` returns columns of doubles.
    A tile is of fixed size, so a group is too."""
    names = sorted(run(np.zeros((size, size))))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by).schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((size, size), np.nan)
        a[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf[value].to_numpy(float)
        got = run(a)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, **{k: float(got[k]) for k in names}}])

    return cells.groupBy(*by).applyInPandas(one, types + "".join(f", {k} double" for k in names))


def burn_polygons(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """(tile, x, y, bits): flags of polygons and lines over a tile's cells, OR-ed.  shapes: tile, bit int, line boolean, xs, ys (arrays, cell units)."""
    from wayline.functions.geometry import fill_polygon, touch_line

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                pts = np.column_stack([np.asarray(r.xs, float), np.asarray(r.ys, float)])
                m = touch_line(pts, width, height) if r.line else fill_polygon([pts], width, height)
                y, x = np.nonzero(m)
                yield pd.DataFrame({"tile": r.tile, "x": x, "y": y, "bit": 1 << r.bit})

    cells = shapes.mapInPandas(run, f"tile {shapes.schema['tile'].dataType.simpleString()}, x int, y int, bit int")
    return cells.groupBy("tile", "x", "y").agg(F.bit_or("bit").alias("bits"))


def finest_zoom(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(x, y, zoom): the finest zoom of the sources that hold a cell.  sources: west, east, south, north (cells), zoom."""
    s = sources.withColumn("x", F.explode(F.sequence("west", "east"))).withColumn("y", F.explode(F.sequence("south", "north")))
    return cells.join(s.groupBy("x", "y").agg(F.max("zoom").alias("zoom")), ["x", "y"], "left").select("x", "y", F.coalesce("zoom", F.lit(0)).alias("zoom"))


def from_ancestor(asked: DataFrame, stored: DataFrame, deepest: int) -> DataFrame:
    """(z, x, y, value, from_z): each asked tile's value from itself or the nearest stored ancestor."""
    up = asked.select("z", "x", "y", F.explode(F.sequence(F.lit(0), F.least(F.col("z"), F.lit(deepest)))).alias("k"))
    up = up.select("z", "x", "y", (F.col("z") - F.col("k")).alias("from_z"), F.floor(F.col("x") / F.pow(F.lit(2), "k")).alias("ax"), F.floor(F.col("y") / F.pow(F.lit(2), "k")).alias("ay"))
    s = stored.select(F.col("z").alias("from_z"), F.col("x").alias("ax"), F.col("y").alias("ay"), "value")
    return up.join(s, ["from_z", "ax", "ay"]).groupBy("z", "x", "y").agg(F.max_by(F.struct("value", "from_z"), "from_z").alias("b")).select("z", "x", "y", "b.value", "b.from_z")
