"""Operators over positions along roads, lines and other series.

A series may hold a third of all rows, so windows are cut into chunks of position: rows are
partitioned by (series, chunk), and what runs over a chunk's edge is handed on by a summary of one row
per chunk, or by copying the rows within reach of the edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNTIL = (Window.unboundedPreceding, 0)
BEFORE = (Window.unboundedPreceding, -1)


#: Length of a chunk, in reaches, of operators that look that far to either side: so many rows in a hundred are copied as 200 over this.
CHUNK_REACHES = 64


def _halo(df: DataFrame, pos: str, reach: float, chunk: float) -> DataFrame:
    """Rows with their chunk ``__c`` and, copied, with those whose rows they are within ``reach`` of; ``__own`` is true in the own one."""
    own = F.floor(F.col(pos) / chunk)
    x = df.withColumn("__c", F.explode(F.sequence(F.floor((F.col(pos) - reach) / chunk), F.floor((F.col(pos) + reach) / chunk))))
    return x.withColumn("__own", F.col("__c") == own)


def _near(df: DataFrame, keys: list[str], pos: str, reach: float, chunk: float | None, columns) -> DataFrame:
    """Adds columns made from the window of the rows within ``reach`` on either side, chunk by chunk; a reach that isn't whole is taken to thousandths.
    Rows without a position stay, with null in the new columns."""
    x = _halo(df.where(F.col(pos).isNotNull()), pos, reach, chunk or CHUNK_REACHES * reach)
    part = Window.partitionBy(*keys, "__c")
    w = part.orderBy(pos).rangeBetween(-int(reach), int(reach)) if float(reach).is_integer() else part.orderBy(F.col(pos) * 1000).rangeBetween(-round(reach * 1000), round(reach * 1000))
    return columns(x, w).where("__own").drop("__c", "__own").unionByName(df.where(F.col(pos).isNull()), allowMissingColumns=True)


def beside(df: DataFrame, keys: list[str], order: list[str], values: list[str], chunk: float) -> DataFrame:
    """Adds ``__c`` (chunk of the first of ``order``), ``__prev`` and ``__next``: structs of ``order`` and ``values`` of the rows before and after in
    the key's order.  Across a chunk's edge they come from a summary of one row per chunk.  Rows without a position or key stay, with nothing beside them."""
    said = F.struct(*order, *[v for v in values if v not in order])
    x = df.withColumn("__c", F.floor(F.col(order[0]) / chunk)).withColumn("__at", said)
    w, by = Window.partitionBy(*keys, "__c").orderBy(*order), Window.partitionBy(*keys).orderBy("__c")
    ends = x.where("__c is not null").groupBy(*keys, "__c").agg(F.min_by("__at", F.struct(*order)).alias("__a"), F.max_by("__at", F.struct(*order)).alias("__b"))
    ends = ends.select(*keys, "__c", F.lag("__b").over(by).alias("__before"), F.lead("__a").over(by).alias("__after"))
    x = x.withColumn("__p", F.lag("__at").over(w)).withColumn("__n", F.lead("__at").over(w)).join(ends, [*keys, "__c"], "left")
    known = F.col("__c").isNotNull()
    return x.withColumn("__prev", F.when(known, F.coalesce("__p", "__before"))).withColumn("__next", F.when(known, F.coalesce("__n", "__after"))).drop("__at", "__p", "__n", "__before", "__after")


def running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` up to and with the row; needs the chunks of beside().  Sums of earlier chunks come from one row per chunk."""
    by = Window.partitionBy(*keys).orderBy("__c").rowsBetween(*BEFORE)
    sums = df.groupBy(*keys, "__c").agg(F.sum(value).alias("__t")).select(*keys, "__c", F.coalesce(F.sum("__t").over(by), F.lit(0)).alias("__t0"))
    w = Window.partitionBy(*keys, "__c").orderBy(*order).rowsBetween(*UNTIL)
    return df.withColumn("__upto", F.sum(value).over(w)).join(sums, [*keys, "__c"]).withColumn(out, F.col("__t0") + F.col("__upto")).drop("__upto", "__t0")


def islands(df: DataFrame, key: str, pos: str, gap: float, chunk: float) -> DataFrame:
    """Adds ``run``: the position at which the row's run starts.  A run ends where the next position is more than
    ``gap`` further.  Rows without key or position are left out; equal positions are in one run."""
    d = df.where(F.col(key).isNotNull() & F.col(pos).isNotNull()).withColumn("__c", F.floor(F.col(pos) / chunk))
    w = Window.partitionBy(key, "__c").orderBy(pos)
    d = d.withColumn("__lag", F.lag(pos).over(w)).withColumn("__new", F.when(F.col("__lag").isNotNull() & (F.col(pos) - F.col("__lag") > gap), F.col(pos)))
    ends = d.groupBy(key, "__c").agg(F.min(pos).alias("__a"), F.max(pos).alias("__b"), F.max("__new").alias("__n"))
    s = Window.partitionBy(key).orderBy("__c")
    ends = ends.withColumn("__p", F.lag("__b").over(s))
    ends = ends.withColumn("__first", F.when(F.col("__p").isNull() | (F.col("__a") - F.col("__p") > gap), F.col("__a")))
    ends = ends.withColumn("__carry", F.coalesce("__first", F.last(F.coalesce("__n", "__first"), ignorenulls=True).over(s.rowsBetween(*BEFORE))))
    d = d.join(ends.select(key, "__c", "__carry"), [key, "__c"])
    return d.withColumn("run", F.coalesce(F.last("__new", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.col("__carry"))).drop("__c", "__lag", "__new", "__carry")


def interval_islands(df: DataFrame, key: str, start: str, end: str, gap: int) -> DataFrame:
    """(k, start, end, n): runs of intervals; one starts more than ``gap`` past the furthest end so far."""
    from wayline.operators.intervals import merge_intervals

    wide = df.withColumn("__e", F.col(end).cast("long") + gap)
    return merge_intervals(wide, key, start, "__e").select("k", "start", (F.col("end") - gap).alias("end"), "n")


def best_window(df: DataFrame, keys: list[str], pos: str, score: str, length: float, reach: float, tie: str | None = None, in_view: str | None = None, block: float | None = None) -> DataFrame:
    """Per ``keys``: the stretch of at least ``length`` with the best mean score; of equal ones the one that starts first.

    Each row opens the stretch that ends at the first row at least ``length`` further on.  ``reach`` is the greatest distance between
    neighbouring rows of a key, so a block needs no rows beyond length + reach of its end.  With ``in_view`` (boolean) the
    stretch's middle row must be in view.  Rows with a null score are left out.  Returns keys, off0, off1, n, mean.
    Keys shorter than ``length`` have no row.
    """
    block = block or max(64 * length, length + reach)
    d = df.where(F.col(pos).isNotNull() & F.col(score).isNotNull()).select(*keys, F.col(pos).alias("pos"), F.col(score).cast("double").alias("score"), *([F.col(tie).alias("tie")] if tie else [F.lit(0).alias("tie")]), (F.col(in_view) if in_view else F.lit(True)).alias("ok"))
    own = F.floor(F.col("pos") / block)
    back = F.floor((F.col("pos") - (length + reach)) / block)
    d = d.withColumn("own", own).withColumn("b", F.explode(F.sequence(back, own)))
    part = [*keys, "b"]
    w = Window.partitionBy(*part).orderBy("pos", "tie")
    d = d.withColumn("i", F.row_number().over(w)).withColumn("pre", F.sum("score").over(w.rowsBetween(*UNTIL)))
    # each row once as itself and, in its own block, once as the point at which its stretch may end, in one descending order: the last row seen is the end
    me = F.struct("i", "pos", "pre", "ok", "score")
    both = F.array(F.struct(F.col("pos").alias("at"), F.lit(0).alias("q"), F.col("i").alias("k")), F.when(F.col("own") == F.col("b"), F.struct((F.col("pos") + length).alias("at"), F.lit(1).alias("q"), F.lit(0).alias("k"))))
    x = d.select(*part, me.alias("ask"), F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e"))
    down = Window.partitionBy(*part).orderBy(F.desc("e.at"), "e.q", F.desc("e.k")).rowsBetween(*UNTIL)
    hit = x.withColumn("end", F.last(F.when(F.col("e.q") == 0, F.col("ask")), ignorenulls=True).over(down)).where("e.q = 1 and end is not null and end.i >= ask.i")
    n = F.col("end.i") - F.col("ask.i") + 1
    hit = hit.select(*part, F.col("ask.i").alias("i"), F.col("ask.pos").alias("off0"), F.col("end.pos").alias("off1"), n.cast("long").alias("n"), ((F.col("end.pre") - F.col("ask.pre") + F.col("ask.score")) / n).alias("mean"), F.floor((F.col("ask.i") + F.col("end.i")) / 2).alias("mid"))
    if in_view:
        hit = hit.join(d.where("ok").select(*part, F.col("i").alias("mid")), [*part, "mid"])
    best = hit.groupBy(*keys).agg(F.max_by(F.struct("off0", "off1", "n", "mean"), F.struct(F.col("mean"), -F.col("off0"), -F.col("i"))).alias("x"))
    return best.select(*keys, "x.*")


def neighbour_grade(df: DataFrame, keys: list[str], pos: str, height: str, tie: str, chunk: float) -> DataFrame:
    """Adds ``grade`` (%) from the rows before and after, one-sided at the ends."""
    from wayline.functions.scoring import grade_percent

    x = beside(df, keys, [pos, tie], [height], chunk)
    side = lambda n, c: F.coalesce(F.col(f"{n}.{c}"), F.col(c))
    return x.withColumn("grade", grade_percent(side("__prev", height), side("__prev", pos), side("__next", height), side("__next", pos))).drop("__c", "__prev", "__next")


def around(df: DataFrame, keys: list[str], pos: str, reach: float, chunk: float | None = None, **aggs: Column) -> DataFrame:
    """Aggregates over the rows within ``reach`` on either side (both ends included)."""
    return _near(df, keys, pos, reach, chunk, lambda x, w: x.withColumns({k: a.over(w) for k, a in aggs.items()}))


def despike(df: DataFrame, keys: list[str], pos: str, value: str, reach: float = 50.0, least: int = 5, floor: float = 8.0, factor: float = 5 * 1.4826, chunk: float | None = None) -> DataFrame:
    """Adds ``clean``: the upper median of the rows within reach where the value is off by more than max(floor, factor
    times their median deviation), else the value; windows of fewer than ``least`` values change nothing."""
    x = _near(df, keys, pos, reach, chunk, lambda x, w: x.withColumn("__near", F.array_sort(F.collect_list(value).over(w))))
    x = x.withColumn("__m", F.get("__near", F.floor(F.size("__near") / 2).cast("int")))
    x = x.withColumn("__d", F.array_sort(F.transform("__near", lambda v: F.abs(v - F.col("__m")))))
    x = x.withColumn("__mad", F.get("__d", F.floor(F.size("__d") / 2).cast("int")))
    off = F.abs(F.col(value) - F.col("__m")) > F.greatest(F.lit(floor), factor * F.col("__mad"))
    return x.withColumn("clean", F.when((F.size("__near") >= least) & off, F.col("__m")).otherwise(F.col(value))).drop("__near", "__m", "__d", "__mad")


def smooth(df: DataFrame, keys: list[str], pos: str, value: str, sigma: float = 15.0, chunk: float | None = None) -> DataFrame:
    """Adds ``smooth``: the mean of the rows within three sigma, by Gaussian weight of distance."""
    near = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    x = _near(df, keys, pos, 3 * sigma, chunk, lambda x, w: x.withColumn("__near", near.over(w)))
    weight = lambda q: F.exp(-F.pow((q["p"] - F.col(pos)) / sigma, 2) / 2)
    top = F.aggregate("__near", F.lit(0.0), lambda a, q: a + weight(q) * q["v"])
    below = F.aggregate("__near", F.lit(0.0), lambda a, q: a + weight(q))
    return x.withColumn("smooth", F.when(below > 0, top / below)).drop("__near")


def fill_gaps(df: DataFrame, keys: list[str], pos: str, value: str, tie: str, chunk: float) -> DataFrame:
    """Adds ``filled``: null values on the line between the nearest valid rows, at the ends the nearest one's value.
    A key without any value stays null.  The valid rows nearest beyond a chunk's edges come from a summary of one row per chunk."""
    x = df.withColumn("__c", F.floor(F.col(pos) / chunk))
    said = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).cast("double").alias("v")))
    at = F.when(F.col(value).isNotNull(), F.struct(pos, tie))
    ends = x.where("__c is not null").groupBy(*keys, "__c").agg(F.min_by(said, at).alias("__lo"), F.max_by(said, at).alias("__hi"))
    by = Window.partitionBy(*keys)
    ends = ends.select(*keys, "__c", F.last("__hi", ignorenulls=True).over(by.orderBy("__c").rowsBetween(*BEFORE)).alias("__before"), F.last("__lo", ignorenulls=True).over(by.orderBy(F.desc("__c")).rowsBetween(*BEFORE)).alias("__after"))
    part = Window.partitionBy(*keys, "__c")
    x = x.withColumn("__a", F.last(said, ignorenulls=True).over(part.orderBy(pos, tie).rowsBetween(*UNTIL))).withColumn("__b", F.last(said, ignorenulls=True).over(part.orderBy(F.desc(pos), F.desc(tie)).rowsBetween(*UNTIL)))
    x = x.join(ends, [*keys, "__c"], "left").withColumn("__a", F.coalesce("__a", "__before")).withColumn("__b", F.coalesce("__b", "__after"))
    a, b = F.col("__a"), F.col("__b")
    line = F.when(b["p"] > a["p"], a["v"] + (b["v"] - a["v"]) * (F.col(pos) - a["p"]) / (b["p"] - a["p"])).otherwise(a["v"])
    return x.withColumn("filled", F.coalesce(F.col(value).cast("double"), line, a["v"], b["v"])).drop("__a", "__b", "__c", "__before", "__after")


def profile(df: DataFrame, keys: list[str], pos: str, unit: float, height: str, tie: str, chunk: float) -> DataFrame:
    """Adds the running distance of the steps between positions (in ``unit``), and the climb, descent and grade of each step."""
    x = beside(df, keys, [pos, tie], [height], chunk)
    x = x.withColumn("__s", F.coalesce((F.col(pos) - F.col(f"__prev.{pos}")) / unit, F.lit(0.0))).withColumn("__dh", F.coalesce(F.col(height) - F.col(f"__prev.{height}"), F.lit(0.0)))
    x = running(x, keys, [pos, tie], "__s", "distance")
    return (
        x.withColumn("climb", F.greatest("__dh", F.lit(0.0))).withColumn("descent", F.greatest(-F.col("__dh"), F.lit(0.0)))
        .withColumn("step_grade", F.when(F.col("__s") > 0, F.abs("__dh") / F.col("__s") * 100)).drop("__s", "__dh", "__c", "__prev", "__next")
    )


def pseudo_samples(bins: DataFrame, off: str, length: str, n: str) -> DataFrame:
    """Each bin as its ``n`` samples spread evenly over its length (one in the middle, or from end to end)."""
    x = bins.withColumn("__i", F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)).cast("int") - 1)))
    at = F.when(F.col(n) > 1, F.col(off) + F.col(length) * F.col("__i") / (F.col(n) - 1)).otherwise(F.col(off) + F.col(length) / 2)
    return x.withColumn("pos", at).withColumn("k", F.col("__i")).drop("__i")


def _bins(keys: list[str], limit: float):
    """Bins of a partition's stretches, rows sorted by stretch and position; a stretch that runs over batches is held until it ends or a bin closes."""
    cols = [*keys, "piece", "k", "off", "length", "n", "mean"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        next_k = 0

        def close(x: pd.DataFrame, whole: bool) -> tuple[list[tuple], pd.DataFrame | None]:
            nonlocal next_k
            rows = []
            of = x.groupby([*keys, "piece"], sort=False, dropna=False).ngroup().to_numpy()
            begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            end = np.append(begin[1:], len(x))
            pos, total = x["pos"].to_numpy(), np.append(0.0, np.cumsum(x["score"].to_numpy()))
            ids = list(zip(*(x[c].to_numpy()[begin].tolist() for c in [*keys, "piece"])))
            for g, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
                while a < b:
                    to = a + int(np.searchsorted(pos[a:b], pos[a] + limit, "left"))
                    to = max(to, a + 1)
                    if to == b and g == len(ids) - 1 and not whole:
                        return rows, x.iloc[a:]
                    rows.append((*ids[g], next_k, pos[a], pos[to - 1] - pos[a], to - a, (total[to] - total[a]) / (to - a)))
                    a, next_k = to, next_k + 1
                next_k = 0
            return rows, None

        for pdf in batches:
            if not len(pdf):
                continue
            rows, held = close(pdf if held is None else pd.concat([held, pdf], ignore_index=True), False)
            if rows:
                yield pd.DataFrame(rows, columns=cols)
        if held is not None:
            yield pd.DataFrame(close(held, True)[0], columns=cols)

    return run


def summary_bins(df: DataFrame, keys: list[str], pos: str, score: str, attr: Column, limit: float, tie: str, chunk: float | None = None) -> DataFrame:
    """Consecutive rows as bins: one closes when the next row is ``limit`` or more past its first, or ``attr`` changes.

    A bin begins in any case where ``attr`` changes or where the row before is ``limit`` or more behind, so a key falls into stretches that are
    binned apart; within one the next bin begins at the first row ``limit`` past this one's begin, found by bisection.  Returns keys, bin (0, 1, ...), off, length, n, mean.
    """
    d = df.where(F.col(pos).isNotNull() & F.col(score).isNotNull()).select(*keys, F.col(pos).cast("double").alias("pos"), F.col(score).cast("double").alias("score"), F.coalesce(attr.cast("string"), F.lit("")).alias("attr"), F.col(tie).alias("tie"))
    x = beside(d, keys, ["pos", "tie"], ["attr"], chunk or CHUNK_REACHES * limit)
    new = F.col("__prev").isNull() | (F.col("__prev.attr") != F.col("attr")) | (F.col("pos") - F.col("__prev.pos") >= limit)
    x = running(x.withColumn("__new", new.cast("long")), keys, ["pos", "tie"], "__new", "piece").select(*keys, "piece", "pos", "tie", "score")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.select(*keys).schema)
    y = x.repartition(*keys, "piece").sortWithinPartitions(*keys, "piece", "pos", "tie").mapInPandas(_bins(keys, limit), f"{types}, piece long, k long, off double, length double, n long, mean double")
    y = running(y.withColumn("__c", F.floor(F.col("off") / (chunk or CHUNK_REACHES * limit))).withColumn("__one", F.lit(1)), keys, ["off", "piece", "k"], "__one", "__bin")
    return y.select(*keys, (F.col("__bin") - 1).cast("long").alias("bin"), "off", "length", "n", "mean")


def thin_with_extrema(offs: np.ndarray, vals: np.ndarray, step: float = 10.0, apart: float = 2.0) -> np.ndarray:
    """Which points of a profile to keep: the ends, one every ``step`` and local extrema more than ``apart`` off the last kept value."""
    n = len(offs)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    keep[0] = keep[-1] = True
    last = 0
    for i in range(1, n - 1):
        turns = (vals[i] - vals[i - 1]) * (vals[i + 1] - vals[i]) < 0
        if offs[i] - offs[last] >= step or (turns and abs(vals[i] - vals[last]) > apart):
            keep[i] = True
            last = i
    return keep


def thin_profiles(df: DataFrame, keys: list[str], pos: str, value: str, step: float = 10.0, apart: float = 2.0) -> DataFrame:
    """thin_with_extrema per key; a key is one way, whose points fit in memory."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        return pdf[thin_with_extrema(pdf[pos].to_numpy(float), pdf[value].to_numpy(float), step, apart)]

    d = df.where(F.col(pos).isNotNull() & F.col(value).isNotNull()).select(*keys, pos, value)
    return d.groupBy(*keys).applyInPandas(run, d.schema)


def as_of(left: DataFrame, right: DataFrame, key: str | None, pos: str, values: list[str], chunk: float) -> DataFrame:
    """For each left row, the right rows at or before (prev_*) and at or after (next_*) its position.

    Either side's positions may tie; of several right rows at one position the greatest values are taken.  Partitioned by (key, chunk):
    the nearest right row of earlier and later chunks comes from a summary of one row per chunk.
    """
    k = [key] if key else []
    r = right.where(F.col(pos).isNotNull()).select(*k, F.col(pos).alias("__p"), F.struct(F.col(pos).alias("p"), *values).alias("__r"))
    ls = left.columns
    u = left.select(*[F.col(c) for c in ls]).withColumn("__p", F.col(pos)).withColumn("__side", F.lit(1)).unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    u = u.withColumn("__c", F.floor(F.col("__p") / chunk))
    edge = r.groupBy(*k, F.floor(F.col("__p") / chunk).alias("__c")).agg(F.max("__r").alias("__hi"), F.min("__r").alias("__lo"))
    chunks = u.select(*k, "__c").distinct().join(edge, [*k, "__c"], "left")
    up, down = Window.partitionBy(*(k or [F.lit(0)])).orderBy("__c"), Window.partitionBy(*(k or [F.lit(0)])).orderBy(F.desc("__c"))
    chunks = chunks.withColumn("__before", F.last("__hi", ignorenulls=True).over(up.rowsBetween(*BEFORE))).withColumn("__after", F.last("__lo", ignorenulls=True).over(down.rowsBetween(*BEFORE)))
    a = Window.partitionBy(*k, "__c").orderBy("__p", "__side", "__r").rowsBetween(*UNTIL)
    b = Window.partitionBy(*k, "__c").orderBy(F.desc("__p"), "__side", F.desc("__r")).rowsBetween(*UNTIL)
    u = u.withColumn("__x", F.last("__r", ignorenulls=True).over(a)).withColumn("__y", F.last("__r", ignorenulls=True).over(b)).where("__side = 1")
    u = u.join(chunks.select(*k, "__c", "__before", "__after"), [*k, "__c"])
    x, y = F.coalesce("__x", "__before"), F.coalesce("__y", "__after")
    names = ["p", *values]
    return u.select(*ls, *[x[n].alias(f"prev_{pos if n == 'p' else n}") for n in names], *[y[n].alias(f"next_{pos if n == 'p' else n}") for n in names])


def event_chain(df: DataFrame, key: str, stage: str, t: str, stages: list[str]) -> DataFrame:
    """Per key the time of each stage: the first such event at or after the stage before it (null from the first missing one on)."""
    out = df.where(F.col(stage) == stages[0]).groupBy(key).agg(F.min(t).alias(f"t_{stages[0]}"))
    for before, s in zip(stages, stages[1:]):
        nxt = df.where(F.col(stage) == s).select(F.col(key).alias("__k"), F.col(t).alias("__t"))
        hit = out.join(nxt, (out[key] == F.col("__k")) & (F.col("__t") >= F.col(f"t_{before}"))).groupBy(key).agg(F.min("__t").alias(f"t_{s}"))
        out = out.join(hit, key, "left")
    return out


def value_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Consecutive whole numbers as runs: (keys, first, last, n)."""
    d = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    d = d.withColumn("__g", F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    return d.groupBy(*keys, "__g").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("__g")


def contiguous(df: DataFrame, keys: list[str], start: str, end: str, tie: str, chunk: float = 1 << 20) -> DataFrame:
    """Adds ``piece``: pieces that follow end to start without a break share a number.  Chunks of positions carry the last end and the breaks so far."""
    x = beside(df, keys, [start, tie], [end], chunk)
    x = x.withColumn("__b", F.coalesce((F.col(f"__prev.{end}") != F.col(start)).cast("int"), F.lit(1)))
    return running(x, keys, [start, tie], "__b", "piece").drop("__b", "__c", "__prev", "__next")


def cyclic_runs(values: DataFrame, keys: list[str], value: str, first: int, last: int) -> DataFrame:
    """(keys, start, stop, n): consecutive values of a cycle first..last (days of a week, months of a year) as runs; one over the end goes on at the
    beginning (start > stop), and all values are one run from first to last."""
    r = value_runs(values.where(F.col(value).between(first, last)), keys, value)
    w = Window.partitionBy(*keys)
    r = r.withColumns({"__a": F.max(F.when((F.col("first") == first) & (F.col("last") < last), F.struct("last", "n"))).over(w), "__z": F.max(F.when((F.col("last") == last) & (F.col("first") > first), F.col("first"))).over(w)})
    both = F.col("__a").isNotNull() & F.col("__z").isNotNull()
    joined = both & (F.col("last") == last)
    x = r.where(~(both & (F.col("first") == first) & (F.col("last") < last)))
    return x.select(*keys, F.col("first").alias("start"), F.when(joined, F.col("__a.last")).otherwise(F.col("last")).alias("stop"), (F.col("n") + F.when(joined, F.col("__a.n")).otherwise(0)).alias("n"))
