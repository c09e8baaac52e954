"""Irregular readings onto a regular grid.

A compact kernel gives every reading weight on the few grid times near it only, so each
reading is sent to those grid times and the weighted local polynomial is solved from
sums: one map-side combined aggregation per (series, grid time), and no task ever holds
a whole series.  Stretches of readings are found from grid cells that hold a reading; the
state that runs over a series is carried between chunks of it by a summary of one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.clean import within
from wayline.session import cut

#: Cells per chunk of a series; the lag within a chunk is a window, between chunks a summary.
CHUNK = 1440


def clean_readings(df: DataFrame, key: Column, t: Column, fields: dict[str, tuple[float, float]]) -> DataFrame:
    """(k, t, fields): rows with a key, a time and a valid value; values out of range, NaN and null are null."""
    rows = df.select(key.alias("k"), t.alias("t"), *[within(F.col(f).cast("double"), *lim).alias(f) for f, lim in fields.items()])
    return rows.where(F.col("k").isNotNull() & F.col("t").isNotNull() & F.coalesce(*fields).isNotNull())


def local_lines(readings: DataFrame, fields: list[str], step: float, bandwidth: float) -> DataFrame:
    """Per (k, chunk, slot) near a reading: the slot's own readings (n, t_min, t_max, ``f_n``) and per field the local line's value and support.

    One shuffle: readings go to their chunk of the series, and those near a chunk's edge to its neighbour too; merging
    readings that were sent again (each field from whichever copy has it, the greatest if copies disagree) and summing keep that layout.
    """
    length = CHUNK * step
    at = lambda d: F.floor((F.col("t") + d) / length)
    rows = readings.withColumn("chunk", F.explode(F.array_distinct(F.array(at(0.0), at(-bandwidth), at(bandwidth))))).repartition("k", "chunk")
    rows = rows.groupBy("k", "chunk", "t").agg(*[F.max(f).alias(f) for f in fields])
    own = F.floor(F.col("t") / step)
    reach = F.sequence(F.least(own, F.ceil((F.col("t") - bandwidth) / step - 0.5)), F.greatest(own, F.floor((F.col("t") + bandwidth) / step - 0.5)))
    rows = rows.select("k", "chunk", "t", *fields, own.alias("own"), F.explode(reach).alias("slot")).where(F.floor(F.col("slot") / CHUNK) == F.col("chunk"))
    u = (F.col("t") - (F.col("slot") + 0.5) * step) / bandwidth
    rows = rows.withColumn("u", u).withColumn("w", F.when(F.abs("u") < 1, F.pow(1 - F.pow(F.abs("u"), 3), 3)).otherwise(0.0))
    here = F.col("own") == F.col("slot")
    aggs = [F.count(F.when(here, 1)).alias("n"), F.min(F.when(here, F.col("t"))).alias("t_min"), F.max(F.when(here, F.col("t"))).alias("t_max")]
    for f in fields:
        w = F.when(F.col(f).isNotNull(), F.col("w"))
        u, y = F.col("u"), F.col(f)
        aggs += [F.count(F.when(here, y)).cast("int").alias(f"{f}_n")] + [
            F.sum(x).alias(f"{f}_{name}") for name, x in (("w", w), ("wu", w * u), ("wuu", w * u * u), ("wy", w * y), ("wuy", w * u * y), ("ww", w * w))
        ]
    sums = rows.groupBy("k", "chunk", "slot").agg(*aggs)
    out: list[Column] = [F.col(c) for c in ("k", "chunk", "slot", "n", "t_min", "t_max")]
    for f in fields:
        s = {x: F.col(f"{f}_{x}") for x in ("w", "wu", "wuu", "wy", "wuy", "ww")}
        det = s["w"] * s["wuu"] - s["wu"] * s["wu"]
        support = F.when(s["ww"] > 0, s["w"] * s["w"] / s["ww"]).otherwise(0.0)
        line = F.when((support >= 2) & (det > 1e-6 * s["w"] * s["w"]), (s["wuu"] * s["wy"] - s["wu"] * s["wuy"]) / det).when(s["w"] > 0, s["wy"] / s["w"])
        out += [F.col(f"{f}_n"), line.alias(f), support.alias(f"{f}_support")]
    return sums.select(*out)


def previous_cell(cells: DataFrame) -> DataFrame:
    """Adds p_slot and p_t: slot and last time of the series' cell before this one.

    Only a chunk's cells are ever sorted together; the last cell of each chunk is passed on to the next."""
    last = cells.groupBy("k", "chunk").agg(F.max(F.struct("slot", "t_max")).alias("last"))
    before = last.withColumn("carry", F.lag("last").over(Window.partitionBy("k").orderBy("chunk"))).drop("last")
    w = Window.partitionBy("k", "chunk").orderBy("slot")
    c = cells.withColumn("prev", F.lag(F.struct("slot", "t_max")).over(w)).join(before, ["k", "chunk"], "left")
    prev = F.coalesce("prev", "carry")
    return c.withColumn("p_slot", prev["slot"]).withColumn("p_t", prev["t_max"]).drop("prev", "carry")


def regular_grid(readings: DataFrame, fields: list[str], step: float = 60, max_gap: float = 1800, bandwidth: float = 150, min_support: float = 1.5) -> DataFrame:
    """One row per series and grid slot of each stretch of readings.

    ``readings`` is as from clean_readings.  Readings at most ``max_gap`` after the one before form a
    stretch; its slots run from its first reading's to its last one's.  Per field: ``f_n`` valid readings
    in the slot, ``f`` the local line's value at the slot's middle (the local mean where the readings near
    it do not fix a line), ``f_support`` the effective number of readings behind it and ``f_mark``:
    'measured' (the slot has a reading), 'filled' (support of at least ``min_support``) or 'missing' (value null).
    Repeated rows count once; an empty input gives an empty grid.
    """
    lines = cut(local_lines(readings, fields, step, bandwidth), keep_layout=True)
    cells = lines.where("n > 0")
    near = previous_cell(cells.select("k", "chunk", "slot", "t_min", "t_max"))
    holes = (
        near.where(F.col("t_min") - F.col("p_t") <= max_gap).where("slot - p_slot > 1")
        .select("k", F.explode(F.sequence(F.col("p_slot") + 1, F.col("slot") - 1)).alias("slot"))
    )
    grid = cells.drop("chunk").unionByName(holes.join(lines.where("n = 0").drop("chunk"), ["k", "slot"], "left").select(*[c for c in lines.columns if c != "chunk"]))
    out: list[Column] = [F.col("k"), F.col("slot"), ((F.col("slot") + 0.5) * step).alias("t")]
    for f in fields:
        n, support = F.coalesce(f"{f}_n", F.lit(0)), F.coalesce(f"{f}_support", F.lit(0.0))
        mark = F.when(n > 0, "measured").when(support >= min_support, "filled").otherwise("missing")
        out += [n.alias(f"{f}_n"), F.when(mark != "missing", F.col(f)).alias(f), F.round(support, 4).alias(f"{f}_support"), mark.alias(f"{f}_mark")]
    return grid.select(*out)


def empty_slots(grid: DataFrame, fields: list[str]) -> DataFrame:
    """(k, slot, field): the slots of a regular_grid in which a field has no valid reading."""
    lacks = F.array(*[F.when(F.col(f"{f}_n") == 0, F.lit(f)) for f in fields])
    return grid.select("k", "slot", F.explode(F.filter(lacks, lambda x: x.isNotNull())).alias("field"))
