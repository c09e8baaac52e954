"""Depths of water from several sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.geometry import distance_transform

#: Drying heights are at most this many metres (fixed value).
DRY_MOST = 15.0


def pick_depths(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """(tile, x, y, depth, source): each water cell's value from the finest survey, else the finest estimate.

    cells: tile, x, y, water ('sea', 'lake' or null for land).  samples: tile, x, y, source, value (metres, negative below the surface), zoom, survey boolean,
    tidal boolean, waters array<string> (kinds of water it is drawn on).  Values above 0 stay, up to DRY_MOST, only of tidal sources; else they are 0."""
    ok = samples.join(cells.where("water is not null"), ["tile", "x", "y"]).where(F.array_contains("waters", F.col("water")) & F.col("value").isNotNull() & ~F.isnan("value"))
    top = F.when(F.col("tidal"), F.least(F.col("value"), F.lit(DRY_MOST))).otherwise(F.least(F.col("value"), F.lit(0.0)))
    best = ok.groupBy("tile", "x", "y").agg(F.min_by(F.struct(top.alias("depth"), "source"), F.struct((~F.col("survey")).cast("int"), -F.col("zoom"), "source")).alias("b"))
    return best.select("tile", "x", "y", "b.depth", "b.source")


def fill_depths(tiles: DataFrame, size: int, reach: float) -> DataFrame:
    """(tile, x, y, depth, filled): water without a value within ``reach`` cells of one gets it, falling linearly to 0 at the shore.
    tiles: tile, x, y, water boolean, depth (null: none).  A tile is of fixed size; a tile without any value stays empty."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wet, has, value = np.zeros((size, size), bool), np.zeros((size, size), bool), np.zeros((size, size))
        x, y = pdf["x"].to_numpy(int), pdf["y"].to_numpy(int)
        wet[y, x] = pdf["water"].to_numpy(bool)
        d = pdf["depth"].to_numpy(float)
        has[y, x] = ~np.isnan(d)
        value[y, x] = np.nan_to_num(d)
        if has.any():
            far, shore = distance_transform(has), distance_transform(~wet)
            fy, fx = np.nonzero(wet & ~has & (far <= reach))
            hy, hx = np.nonzero(has)
            for r, c in zip(fy, fx):
                k = int(((hy - r) ** 2 + (hx - c) ** 2).argmin())
                s = shore[r, c]
                value[r, c] = value[hy[k], hx[k]] * (1.0 if np.isinf(s) else s / (s + far[r, c]))
                has[r, c] = True
        known = has[y, x]
        return pd.DataFrame({"tile": pdf["tile"], "x": x, "y": y, "depth": np.where(known, value[y, x], np.nan), "filled": known & np.isnan(d)})

    t = tiles.schema["tile"].dataType.simpleString()
    return tiles.groupBy("tile").applyInPandas(run, f"tile {t}, x int, y int, depth double, filled boolean")
