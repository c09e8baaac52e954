"""Overlapping and gapped intervals per entity, without a per-entity task.

Intervals are range-sorted by (entity, start) over all partitions.  Each partition
reports its greatest end and the start of its last local island per entity; a prefix
combination of these reports gives each partition the state it begins with, and a
second pass over the sorted rows labels the islands.  At most one carried state per
partition exists, so the only broadcast has fewer rows than there are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import cut, shuffle_width

LOW = np.iinfo(np.int64).min


def sorted_intervals(df: DataFrame, key: str, start: str, end: str, parts: int | None = None) -> DataFrame:
    """(k, s, e, pid): valid intervals in global order; rows without key, start or end, or that
    end before they start, are left out."""
    parts = parts or shuffle_width(df.sparkSession)
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("k is not null and s is not null and e is not null and e >= s")
    return cut(rows.repartitionByRange(parts, "k", "s", "e").sortWithinPartitions("k", "s", "e").withColumn("pid", F.spark_partition_id()), keep_layout=True)


def _scan(k: np.ndarray, s: np.ndarray, e: np.ndarray, carry_k: str | None, carry_e: int, carry_s: int):
    """Island starts of rows sorted by (k, s): running greatest end before each row, and label."""
    n = len(k)
    fresh = np.empty(n, bool)
    fresh[0] = k[0] != carry_k
    fresh[1:] = k[1:] != k[:-1]
    begin = np.flatnonzero(fresh)
    bounds = np.append(begin if len(begin) and begin[0] == 0 else np.insert(begin, 0, 0), n)
    before = np.empty(n, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        first = LOW if fresh[a] else carry_e
        before[a] = first
        before[a + 1 : b] = np.maximum(np.maximum.accumulate(e[a : b - 1]), first)
    new = s > before
    at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
    label = np.where(at >= 0, s[np.maximum(at, 0)], carry_s)
    return before, new, label


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Scans a partition's batches, keeping the state between them; c_e and c_s are the state
    that the partition was handed for its first entity."""
    key, last_e, last_s = None, LOW, LOW
    for pdf in batches:
        if not len(pdf):
            continue
        k, s, e = pdf["k"].to_numpy(), pdf["s"].to_numpy(np.int64), pdf["e"].to_numpy(np.int64)
        if key is None and "c_e" in pdf and not pd.isna(pdf["c_e"].iloc[0]):
            key, last_e, last_s = k[0], int(pdf["c_e"].iloc[0]), int(pdf["c_s"].iloc[0])
        before, new, label = _scan(k, s, e, key, last_e, last_s)
        yield pdf, before, new, label
        key, last_e, last_s = k[-1], max(int(before[-1]), int(e[-1])), int(label[-1])


def _summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf, _, _, label in _walk(batches):
        yield pd.DataFrame({"pid": pdf["pid"], "k": pdf["k"], "e": pdf["e"], "last_s": label}).groupby(["pid", "k"], sort=False).agg(max_e=("e", "max"), last_s=("last_s", "max")).reset_index()


def _label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf, before, new, label in _walk(batches):
        had = new & (before != LOW)
        yield pd.DataFrame({"k": pdf["k"], "label": label, "s": pdf["s"], "e": pdf["e"], "gap_from": pd.Series(np.where(had, before, 0)).where(had).astype("Int64")})


def island_rows(df: DataFrame, key: str, start: str, end: str, parts: int | None = None) -> DataFrame:
    """Each interval (k, s, e) with its island's ``label`` (the island's start) and, on the first
    interval of an island that has one before it, ``gap_from``, the end of that one.

    Closed intervals: those that touch are one island.  Repeated rows and ties change nothing.
    """
    rows = sorted_intervals(df, key, start, end, parts)
    per = rows.select("k", "s", "e", "pid").mapInPandas(_summary, "pid int, k string, max_e long, last_s long").groupBy("k", "pid").agg(F.max("max_e").alias("max_e"), F.max("last_s").alias("last_s"))
    before = Window.partitionBy("k").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    state = per.withColumn("c_e", F.max("max_e").over(before)).withColumn("own_s", F.when(F.col("c_e").isNull() | (F.col("last_s") > F.col("c_e")), F.col("last_s"))).withColumn("c_s", F.last("own_s", ignorenulls=True).over(before))
    # an entity that begins in an earlier partition fills the partitions between: fewer rows than partitions
    carry = F.broadcast(state.where("c_e is not null").select(F.col("k").alias("c_k"), F.col("pid").alias("c_pid"), "c_e", "c_s"))
    joined = rows.join(carry, (F.col("k") == F.col("c_k")) & (F.col("pid") == F.col("c_pid")), "left").select("k", "s", "e", "c_e", "c_s")
    return joined.mapInPandas(_label, "k string, label long, s long, e long, gap_from long")


def merge_intervals(df: DataFrame, key: str, start: str, end: str, parts: int | None = None) -> DataFrame:
    """(k, start, end, n, gap_from): each maximal continuous period, its number of intervals, and the
    end of the period before it (null for an entity's first)."""
    return island_rows(df, key, start, end, parts).groupBy("k", "label").agg(F.max("e").alias("end"), F.count("*").alias("n"), F.max("gap_from").alias("gap_from")).select("k", F.col("label").alias("start"), "end", "n", "gap_from")


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, max_gap: int | None = None, parts: int | None = None) -> DataFrame:
    """(k, what, start, end) with what 'busy' or 'gap'; gaps longer than ``max_gap`` are not listed."""
    merged = merge_intervals(df, key, start, end, parts)
    ok = F.lit(True) if max_gap is None else (F.col("start") - F.col("gap_from") <= max_gap)
    both = F.array(
        F.struct(F.lit("busy").alias("what"), F.col("start").alias("a"), F.col("end").alias("b")),
        F.when(F.col("gap_from").isNotNull() & ok, F.struct(F.lit("gap").alias("what"), F.col("gap_from").alias("a"), F.col("start").alias("b"))),
    )
    return merged.select("k", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("k", "x.what", F.col("x.a").alias("start"), F.col("x.b").alias("end"))
