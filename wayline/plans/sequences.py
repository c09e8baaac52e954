"""Sequence, timetable and route queries on the test tables: events stand for samples along roads (road = user,
offset = microseconds, score = value), orders and line items for rows of lines and stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import scoring as S
from wayline.operators import sequences as Q
from wayline.operators import timetables as T
from wayline.session import cut, table

HOUR = 3_600_000_000
GAP, LENGTH, BIN, CHUNK = 12 * HOUR, 2 * HOUR, 6 * HOUR, 240 * HOUR


def micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("road"), micros("ts").alias("off"), "event_id", "event_type", F.col("value").alias("score"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return Q.islands(samples(spark, d), "road", "off", GAP, CHUNK)


def best_stretch(spark: SparkSession, d: str) -> DataFrame:
    """The best stretch of two hours or more of each run."""
    x = Q.best_window(runs(spark, d), ["road", "run"], "off", "score", LENGTH, GAP, tie="event_id")
    return x.select("road", "run", "off0", "off1", "n", F.round("mean", 5).alias("mean"))


def drives_top(spark: SparkSession, d: str) -> DataFrame:
    """L1: the twenty best, and how many there are."""
    # one row per run is kept, so that the list and the count don't work it out twice
    x = cut(best_stretch(spark, d))
    return x.orderBy(F.desc("mean"), "road", "off0").limit(20).withColumn("total", F.lit(x.count()))


def drives_in_view(spark: SparkSession, d: str) -> DataFrame:
    """W3 with the view test on the middle sample: here, purchases and views are in view."""
    x = runs(spark, d).withColumn("seen", F.col("score") >= 10)
    x = Q.best_window(x, ["road", "run"], "off", "score", LENGTH, GAP, tie="event_id", in_view="seen")
    return x.select("road", "run", "off0", "off1", "n", F.round("mean", 5).alias("mean"))


def runs_summary(spark: SparkSession, d: str) -> DataFrame:
    """G3 over W1."""
    return runs(spark, d).groupBy("road", "run").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.max("score").alias("most"), F.max("off").alias("last"))


def interval_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as intervals of their value in minutes."""
    x = samples(spark, d).withColumn("to", (F.col("off") + F.round(F.col("score") * 60e6)).cast("long"))
    return Q.interval_islands(x, "road", "off", "to", 2 * HOUR).select(F.col("k").cast("long").alias("road"), F.col("start").alias("off0"), F.col("end").alias("off1"), "n")


def neighbour_grade(spark: SparkSession, d: str) -> DataFrame:
    """Grade from the neighbours; offsets in seconds."""
    x = samples(spark, d).withColumn("sec", F.col("off") / 1e6)
    return Q.neighbour_grade(x, ["road"], "sec", "score", "event_id", CHUNK / 1e6).select("event_id", F.round("grade", 6).alias("grade"))


def range_window_sum(spark: SparkSession, d: str) -> DataFrame:
    """What is turned within reach over its span."""
    x = Q.around(samples(spark, d), ["road"], "off", 6 * HOUR, turned=F.sum("score"), lo=F.min("off"), hi=F.max("off"))
    return x.select("event_id", F.round(F.col("turned") / F.greatest((F.col("hi") - F.col("lo")) / 3.6e9, F.lit(0.1)), 5).alias("curviness"))


def window_grade(spark: SparkSession, d: str) -> DataFrame:
    """Slope across the rows within reach."""
    at = F.struct("off", "event_id", "score")
    x = Q.around(samples(spark, d), ["road"], "off", 6 * HOUR, a=F.min(at), b=F.max(at))
    rise, run = F.col("b.score") - F.col("a.score"), (F.col("b.off") - F.col("a.off")) / 3.6e9
    return x.select("event_id", F.round(F.when(run > 0, rise / run).otherwise(0.0), 5).alias("slope"))


def despiked(spark: SparkSession, d: str) -> DataFrame:
    """W8."""
    return Q.despike(samples(spark, d), ["road"], "off", "score", 24 * HOUR).select("event_id", "clean")


def smoothed(spark: SparkSession, d: str) -> DataFrame:
    """W9."""
    x = samples(spark, d).withColumn("h", F.col("off") / 3.6e9)
    return Q.smooth(x, ["road"], "h", "score", 4.0).select("event_id", F.round("smooth", 5).alias("smooth"))


def gap_filled(spark: SparkSession, d: str) -> DataFrame:
    """Values above 100 count as missing."""
    x = samples(spark, d).withColumn("v", F.when(F.col("score") <= 100, F.col("score")))
    return Q.fill_gaps(x, ["road"], "off", "v", "event_id", CHUNK).select("event_id", F.round("filled", 5).alias("filled"))


def junction_blend(spark: SparkSession, d: str) -> DataFrame:
    """Heights near a run's ends move to the mean of the ends that meet in a node (here: one node per day), fading over twelve hours."""
    x = runs(spark, d)
    ends = x.groupBy("road", "run").agg(F.min(F.struct("off", "event_id", "score")).alias("a"), F.max(F.struct("off", "event_id", "score")).alias("b"))
    ends = ends.select("road", "run", F.explode(F.array(F.col("a"), F.col("b"))).alias("e")).select("road", "run", "e.off", "e.score").distinct()
    node = F.floor(F.col("off") / (24 * HOUR))
    mean = ends.groupBy(node.alias("node")).agg(F.avg("score").alias("level"))
    shift = ends.withColumn("node", node).join(mean, "node").select("road", "run", F.col("off").alias("at"), (F.col("level") - F.col("score")).alias("shift"))
    fade = F.greatest(1 - F.abs(F.col("off") - F.col("at")) / (12 * HOUR), F.lit(0.0))
    out = x.join(shift, ["road", "run"]).groupBy("event_id").agg(F.sum(fade * F.col("shift")).alias("by"), F.max("score").alias("score"))
    return out.select("event_id", F.round(F.col("score") + F.col("by"), 5).alias("height"))


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Length, climb, descent and grades of each road."""
    p = Q.profile(samples(spark, d), ["road"], "off", 3.6e9, "score", "event_id", CHUNK)
    return p.groupBy("road").agg(
        F.round(F.max("distance"), 4).alias("length"), F.round(F.sum("climb"), 4).alias("climb"), F.round(F.sum("descent"), 4).alias("descent"),
        F.round(F.max("step_grade"), 3).alias("steepest"), F.min("score").alias("lowest"), F.max("score").alias("highest"),
    )


def bin_summary(spark: SparkSession, d: str) -> DataFrame:
    """G2."""
    x = Q.summary_bins(runs(spark, d), ["road", "run"], "off", "score", F.col("event_type"), float(BIN), "event_id")
    return x.select("road", "run", "bin", F.col("off").cast("long").alias("off"), F.col("length").cast("long").alias("length"), "n", F.round("mean", 5).alias("mean"))


def pseudo_samples(spark: SparkSession, d: str) -> DataFrame:
    """Bins of a day as evenly spread samples."""
    b = runs(spark, d).groupBy("road", F.floor(F.col("off") / (24 * HOUR)).alias("day")).agg(F.min("off").alias("o"), (F.max("off") - F.min("off")).alias("l"), F.count("*").alias("n"))
    return Q.pseudo_samples(b, "o", "l", "n").select("road", "day", "k", F.floor("pos").cast("long").alias("pos"))


def approx_vs_exact(spark: SparkSession, d: str) -> DataFrame:
    """How the best stretches found on bins agree with the exact ones."""
    exact = best_stretch(spark, d).select("road", "run", F.col("mean").alias("exact"))
    bins = Q.summary_bins(runs(spark, d), ["road", "run"], "off", "score", F.lit(""), float(HOUR), "event_id")
    pts = Q.pseudo_samples(bins.withColumnRenamed("off", "o"), "o", "length", "n").withColumn("p", F.round("pos").cast("long"))
    approx = Q.best_window(pts, ["road", "run"], "p", "mean", LENGTH, GAP).select("road", "run", F.col("mean").alias("approx"))
    both = exact.join(approx, ["road", "run"], "full")
    return both.agg(F.count("*").alias("runs"), F.count(F.when(F.col("exact").isNotNull() & F.col("approx").isNotNull(), 1)).alias("in_both"), F.round(F.max(F.abs(F.col("exact") - F.col("approx"))), 6).alias("worst"), F.round(F.avg(F.abs(F.col("exact") - F.col("approx"))), 6).alias("mean_error"))


def thinned_profile(spark: SparkSession, d: str) -> DataFrame:
    """W14."""
    x = samples(spark, d).withColumn("h", F.col("off") / 3.6e9)
    return Q.thin_profiles(x, ["road"], "h", "score", 24.0, 20.0).select("road", F.round("h", 6).alias("h"), "score")


def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """For each order of customers 1 to 150 shifted onto the events' days, the event before and after it, and the value between."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("road"), (F.lit(1704067200000000) + (F.col("o_orderkey") * 7919 % 2_592_000) * 1_000_000).alias("off"))
    x = Q.as_of(o, samples(spark, d).groupBy("road", "off").agg(F.max("score").alias("score")), "road", "off", ["score"], CHUNK)
    a, b, t = F.col("prev_off"), F.col("next_off"), F.col("off")
    line = F.when(b > a, F.col("prev_score") + (F.col("next_score") - F.col("prev_score")) * (t - a) / (b - a)).otherwise(F.col("prev_score"))
    return x.select("o_orderkey", a.alias("prev_off"), b.alias("next_off"), F.round(F.coalesce(line, F.col("prev_score"), F.col("next_score")), 5).alias("between"))


def event_chain(spark: SparkSession, d: str) -> DataFrame:
    """View, then click, then purchase, by user; first after the one before."""
    x = Q.event_chain(samples(spark, d), "road", "event_type", "off", ["view", "click", "purchase"])
    return x.select("road", *[F.col(f"t_{s}") for s in ("view", "click", "purchase")])


def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    """Median time between the stages."""
    x = event_chain(spark, d)
    return x.agg(F.percentile(F.col("t_click") - F.col("t_view"), 0.5).alias("to_click"), F.percentile(F.col("t_purchase") - F.col("t_click"), 0.5).alias("to_purchase"))


def day_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive days with events, per type and user."""
    x = table(spark, d, "events").select("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day"), "user_id")
    return Q.value_runs(x, ["event_type", "user_id"], "day")


def weekday_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of weekdays (1 Monday to 7 Sunday) on which a user's events of a type fall, over the week's end too."""
    x = table(spark, d, "events").select("event_type", "user_id", (F.weekday("ts") + 1).alias("day"))
    return Q.cyclic_runs(x, ["event_type", "user_id"], "day", 1, 7)


def month_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of months in which a customer's orders of a priority fall, over the new year too."""
    x = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.month("o_orderdate").alias("month"))
    return Q.cyclic_runs(x, ["o_custkey", "o_orderpriority"], "month", 1, 12)


def contiguity(spark: SparkSession, d: str) -> DataFrame:
    """Line items of an order joined end to end (number to number plus one; those of every third part end one further on, where it breaks)."""
    a = F.col("l_linenumber")
    x = table(spark, d, "lineitem").select("l_orderkey", a.alias("a"), (a + 1 + (F.col("l_partkey") % 3 == 0).cast("int")).alias("b"))
    y = Q.contiguous(x, ["l_orderkey"], "a", "b", "b")
    return y.groupBy("l_orderkey", "piece").agg(F.min("a").alias("first"), F.max("b").alias("last"), F.count("*").alias("n"))


def first_per_line(spark: SparkSession, d: str) -> DataFrame:
    """One best stretch per line (the user's group), the thirty best."""
    x = best_stretch(spark, d).withColumn("line", F.col("road") % 40)
    y = x.groupBy("line").agg(F.min_by(F.struct("road", "off0", "mean"), F.struct(-F.col("mean"), "road", "off0")).alias("x")).select("line", "x.*")
    return y.orderBy(F.desc("mean"), "line").limit(30)


def lines_by_identity(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a line summed, merged by identity, those long enough, longest first."""
    o = table(spark, d, "orders")
    run = o.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("km"), F.count("*").alias("stops"), F.max("o_totalprice").alias("most"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    x = run.join(c, "o_custkey").groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.sum("km"), 2).alias("km"), F.sum("stops").alias("stops"), F.max("most").alias("most"), F.count("*").alias("runs"))
    return x.where("km >= 2000").orderBy(F.desc("km"), "c_mktsegment", "c_nationkey").limit(40)


def component_score(spark: SparkSession, d: str) -> DataFrame:
    """Weighted components of line items."""
    li = table(spark, d, "lineitem")
    parts = [F.least(F.col("l_quantity") / 50.0, F.lit(1.0)), F.least(F.col("l_extendedprice") / 100000.0, F.lit(1.0)), F.col("l_discount") * 10.0, S.clamp((F.col("l_tax") - 0.02) * 20.0, 0.0, 1.0)]
    return li.groupBy("l_orderkey").agg(F.round(F.avg(S.weighted_score(parts, [1.0, 0.5, -0.25, 2.0])), 4).alias("score"), F.count("*").alias("n"))


def drive_score(spark: SparkSession, d: str) -> DataFrame:
    """Drive and ride scores of samples whose channels are made from line items."""
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17
    ch = F.array(*[((k * (7 + 2 * i) + 13 * i) % 256).cast("int") for i in range(13)])
    drive = S.weighted_score(S.drive_components(ch), [1.0, 0.8, 0.6, 0.5, 0.3, 0.4, 0.2, 0.3, -0.5, -0.3, 1.0, 0.5])
    ride = S.ride_score(S.ride_components(ch, F.col("l_quantity") * 10.0, (k % 8).cast("int"), F.col("l_tax") * 100.0), (k % 60 - 10).cast("double"), [1.0, 0.8, 0.6, 0.5, 0.3, 0.4, 0.2, -0.3, 0.5, 0.3, 0.7])
    return li.groupBy("l_suppkey").agg(F.round(F.avg(drive), 6).alias("drive"), F.round(F.avg(ride), 6).alias("ride"))


def bitmask_filter(spark: SparkSession, d: str) -> DataFrame:
    """Ways by class, surface, toll, name, length and service group."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_partkey") % 15).cast("int").alias("class"),
        (F.when(F.col("l_returnflag") == "R", 1).otherwise(0) + F.when(F.col("l_linestatus") == "F", 2).otherwise(0) + F.when(F.col("l_suppkey") % 4 == 0, 4).otherwise(0) + F.when(F.col("l_suppkey") % 11 == 0, 8).otherwise(0)).cast("int").alias("flags"),
        (F.col("l_partkey") % 5).cast("int").alias("groups"),
    )
    keep = S.drive_filter(F.col("class"), F.col("flags"), 0b0111_0110_1101_011, 3, 1, 0b101) & S.length_filter(F.col("l_quantity"), 5, 40) & S.rail_group_filter(F.col("groups"), F.col("class"), 0b1011)
    return li.where(keep).groupBy("class", "flags").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("length"))


def typical_day(spark: SparkSession, d: str) -> DataFrame:
    """The median-busy Tuesday to Thursday of each customer segment."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return T.typical_day(o.select("c_mktsegment", F.to_date("o_orderdate").alias("date")), "c_mktsegment", "date")


def stop_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive stops of trips; a trip is an order, a stop its line item's supplier."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.col("l_suppkey").alias("stop"))
    return T.stop_pairs(li, "trip", "seq", "stop")


def headways(spark: SparkSession, d: str) -> DataFrame:
    """Median gap between events of a type between 7 and 19 h, and days served."""
    return T.headways(table(spark, d, "events"), "event_type", "ts")


def low_season(spark: SparkSession, d: str) -> DataFrame:
    """Months in which an order priority runs at less than 0.8 of its median month, and gaps of 30 days or more."""
    return T.low_months(table(spark, d, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("date")), "o_orderpriority", "date")


QUERIES = {
    f.__name__: f
    for f in (
        best_stretch, drives_top, drives_in_view, runs_summary, interval_runs, neighbour_grade, range_window_sum, window_grade, despiked, smoothed, gap_filled, junction_blend, profile, bin_summary,
        pseudo_samples, approx_vs_exact, thinned_profile, asof_join, event_chain, stage_durations, day_runs, weekday_runs, month_runs, contiguity, first_per_line, lines_by_identity, component_score, drive_score, bitmask_filter,
        typical_day, stop_pairs, headways, low_season,
    )
}

def _cycle(keys: str, value: str, source: str, last: int) -> str:
    """Runs of the values 1..last per keys: a run begins where the value before it in the cycle is missing, and ends at the last value that follows."""
    return f"""with v as (select distinct {keys}, {value} as v from {source}), c as (select {keys}, list(v) as has, count(*) as m from v group by {keys}),
b as (select {keys}, v as start, has, m from v join c using ({keys}) where m = {last} and v = 1 or m < {last} and not list_contains(has, (v + {last - 2}) % {last} + 1)),
n as (select {keys}, start, case when m = {last} then {last} else (select min(k) from range(1, {last + 1}) t(k) where not list_contains(has, (start - 1 + k) % {last} + 1)) end as n from b)
select {keys}, cast(start as int) as start, cast((start + n - 2) % {last} + 1 as int) as stop, n from n"""


_S = """s as (select user_id as road, epoch_us(ts) as off, event_id, event_type, value as score from events)"""
_RUN = f"""{_S}, lagged as (select *, lag(off) over (partition by road order by off, event_id) as p from s),
marked as (select *, case when p is null or off - p > {GAP} then off end as st from lagged),
r as (select road, off, event_id, event_type, score, max(st) over (partition by road order by off, event_id rows unbounded preceding) as run from marked)"""
_BEST = f"""{_RUN}, idx as (select *, row_number() over (partition by road, run order by off, event_id) as i,
  sum(score) over (partition by road, run order by off, event_id rows unbounded preceding) as pre from r),
j as (select *, min(i) over (partition by road, run order by off range between {LENGTH} following and unbounded following) as j from idx),
hit as (select a.road, a.run, a.i, a.off as off0, b.off as off1, b.i - a.i + 1 as n, (b.pre - a.pre + a.score) / (b.i - a.i + 1) as mean, (a.i + b.i) // 2 as mid from j a join idx b on a.road = b.road and a.run = b.run and b.i = a.j),
best as (select *, row_number() over (partition by road, run order by mean desc, i) as rn from hit)"""
SQL = {
    "best_stretch": f"with {_BEST} select road, run, off0, off1, n, round(mean, 5) as mean from best where rn = 1",
    "drives_top": f"with {_BEST}, x as (select road, run, off0, off1, n, round(mean, 5) as mean from best where rn = 1) select x.*, (select count(*) from x) as total from x order by mean desc, road, off0 limit 20",
    "drives_in_view": f"with {_BEST}, v as (select h.*, row_number() over (partition by h.road, h.run order by h.mean desc, h.i) as rv from hit h join idx m on m.road = h.road and m.run = h.run and m.i = h.mid where m.score >= 10) select road, run, off0, off1, n, round(mean, 5) as mean from v where rv = 1",
    "runs_summary": f"with {_RUN} select road, run, count(*) as n, round(sum(score), 4) as total, max(score) as most, max(off) as last from r group by road, run",
    "interval_runs": f"""with {_S}, i as (select road, off as a, cast(off + round(score * 60e6) as bigint) as b from s),
m as (select *, max(b) over (partition by road order by a, b rows between unbounded preceding and 1 preceding) as p from i),
g as (select *, sum(case when p is null or a - p > {2 * HOUR} then 1 else 0 end) over (partition by road order by a, b rows unbounded preceding) as g from m)
select road, min(a) as off0, max(b) as off1, count(*) as n from g group by road, g""",
    "neighbour_grade": f"""with {_S}, n as (select *, coalesce(lag(score) over w, score) as e0, coalesce(lag(off) over w, off) as o0, coalesce(lead(score) over w, score) as e1, coalesce(lead(off) over w, off) as o1 from s window w as (partition by road order by off, event_id))
select event_id, round(least(abs(e1 - e0) / greatest(abs(o1 - o0) / 1e6, 1) * 100, 30), 6) as grade from n""",
    "range_window_sum": f"""with {_S} select event_id, round(sum(score) over w / greatest((max(off) over w - min(off) over w) / 3.6e9, 0.1), 5) as curviness from s
window w as (partition by road order by off range between {6 * HOUR} preceding and {6 * HOUR} following)""",
    "window_grade": f"""with {_S}, x as (select a.event_id, arg_min(b.score, (b.off, b.event_id)) as s0, arg_max(b.score, (b.off, b.event_id)) as s1, (max(b.off) - min(b.off)) / 3.6e9 as run from s a join s b on a.road = b.road and b.off between a.off - {6 * HOUR} and a.off + {6 * HOUR} group by a.event_id)
select event_id, round(case when run > 0 then (s1 - s0) / run else 0 end, 5) as slope from x""",
    "despiked": f"""with {_S}, near as (select a.event_id, any_value(a.score) as score, list_sort(list(b.score)) as v from s a join s b on a.road = b.road and b.off between a.off - {24 * HOUR} and a.off + {24 * HOUR} group by a.event_id),
m as (select *, v[len(v) // 2 + 1] as med from near), dd as (select *, list_sort(list_transform(v, lambda x: abs(x - med))) as dv from m)
select event_id, case when len(v) >= 5 and abs(score - med) > greatest(8, 5 * 1.4826 * dv[len(dv) // 2 + 1]) then med else score end as clean from dd""",
    "smoothed": f"""with {_S} select a.event_id, round(sum(exp(-pow((b.off - a.off) / 3.6e9 / 4.0, 2) / 2) * b.score) / sum(exp(-pow((b.off - a.off) / 3.6e9 / 4.0, 2) / 2)), 5) as smooth
from s a join s b on a.road = b.road and b.off / 3.6e9 between a.off / 3.6e9 - 12.0 and a.off / 3.6e9 + 12.0 group by a.event_id""",
    "gap_filled": f"""with {_S}, v as (select *, case when score <= 100 then score end as v, row_number() over (partition by road order by off, event_id) as i from s),
ok as (select * from v where v is not null),
b as (select v.*, (select max(o.i) from ok o where o.road = v.road and o.i <= v.i) as ia, (select min(o.i) from ok o where o.road = v.road and o.i >= v.i) as ib from v)
select b.event_id, round(coalesce(b.v, case when q.off > p.off then p.v + (q.v - p.v) * (b.off - p.off) / (q.off - p.off) else p.v end, p.v, q.v), 5) as filled
from b left join v p on p.road = b.road and p.i = b.ia left join v q on q.road = b.road and q.i = b.ib""",
    "junction_blend": f"""with {_RUN}, e as (select road, run, min(off) as off, arg_min(score, (off, event_id)) as score from r group by road, run union select road, run, max(off), arg_max(score, (off, event_id)) from r group by road, run),
n as (select off // {24 * HOUR} as node, avg(score) as level from e group by 1), sh as (select e.road, e.run, e.off as at, level - score as shift from e join n on n.node = e.off // {24 * HOUR})
select r.event_id, round(max(r.score) + sum(greatest(1 - abs(r.off - sh.at) / {12 * HOUR}, 0) * sh.shift), 5) as height from r join sh on sh.road = r.road and sh.run = r.run group by r.event_id""",
    "profile": f"""with {_S}, x as (select *, coalesce((off - lag(off) over w) / 3.6e9, 0) as step, coalesce(score - lag(score) over w, 0) as dh from s window w as (partition by road order by off, event_id))
select road, round(sum(step), 4) as length, round(sum(greatest(dh, 0)), 4) as climb, round(sum(greatest(-dh, 0)), 4) as descent, round(max(case when step > 0 then abs(dh) / step * 100 end), 3) as steepest, min(score) as lowest, max(score) as highest from x group by road""",
    "bin_summary": f"""with recursive {_RUN}, ix as (select *, row_number() over (partition by road, run order by off, event_id) as i from r),
b(road, run, i, bin, off0, attr) as (select road, run, i, 0, off, event_type from ix where i = 1 union all
  select x.road, x.run, x.i, case when x.event_type = b.attr and x.off - b.off0 < {BIN} then b.bin else b.bin + 1 end, case when x.event_type = b.attr and x.off - b.off0 < {BIN} then b.off0 else x.off end, x.event_type
  from b join ix x on x.road = b.road and x.run = b.run and x.i = b.i + 1)
select b.road, b.run, b.bin, b.off0 as off, max(x.off) - b.off0 as length, count(*) as n, round(avg(x.score), 5) as mean from b join ix x on x.road = b.road and x.run = b.run and x.i = b.i group by b.road, b.run, b.bin, b.off0""",
    "pseudo_samples": f"""with {_S}, b as (select road, off // {24 * HOUR} as day, min(off) as o, max(off) - min(off) as l, count(*) as n from s group by 1, 2)
select road, day, cast(k as int) as k, cast(floor(case when n > 1 then o + l * k / (n - 1) else o + l / 2 end) as bigint) as pos from (select *, unnest(generate_series(0, n - 1)) as k from b)""",
    "asof_join": f"""with s as (select user_id as road, epoch_us(ts) as off, max(value) as score from events group by 1, 2),
o as (select o_orderkey, o_custkey % 150 as road, 1704067200000000 + (o_orderkey * 7919 % 2592000) * 1000000 as off from orders),
x as (select o.*, p.off as prev_off, p.score as ps from o asof left join s p on p.road = o.road and p.off <= o.off),
y as (select x.*, n.off as next_off, n.score as ns from x asof left join s n on n.road = x.road and n.off >= x.off)
select o_orderkey, prev_off, next_off, round(coalesce(case when next_off > prev_off then ps + (ns - ps) * (off - prev_off) / (next_off - prev_off) else ps end, ps, ns), 5) as between from y""",
    "event_chain": f"""with {_S}, a as (select road, min(off) as t_view from s where event_type = 'view' group by road),
b as (select a.road, any_value(t_view) as t_view, min(s.off) as t_click from a left join s on s.road = a.road and s.event_type = 'click' and s.off >= t_view group by a.road)
select b.road, any_value(t_view) as t_view, any_value(t_click) as t_click, min(s.off) as t_purchase from b left join s on s.road = b.road and s.event_type = 'purchase' and s.off >= t_click group by b.road""",
    "stage_durations": "with c as ({EVENT_CHAIN}) select median(t_click - t_view) as to_click, median(t_purchase - t_click) as to_purchase from c",
    "day_runs": """with d as (select distinct event_type, user_id, date_diff('day', date '2024-01-01', cast(ts as date)) as day from events),
g as (select *, day - row_number() over (partition by event_type, user_id order by day) as g from d) select event_type, user_id, min(day) as first, max(day) as last, count(*) as n from g group by event_type, user_id, g""",
    "contiguity": """with x as (select l_orderkey, l_linenumber as a, l_linenumber + 1 + case when l_partkey % 3 = 0 then 1 else 0 end as b from lineitem),
y as (select *, row_number() over (partition by l_orderkey order by a, b) as rn, lag(b) over (partition by l_orderkey order by a, b) as p from x),
z as (select *, sum(case when rn = 1 or p <> a then 1 else 0 end) over (partition by l_orderkey order by rn) as piece from y)
select l_orderkey, piece, min(a) as first, max(b) as last, count(*) as n from z group by l_orderkey, piece""",
    "first_per_line": f"with {_BEST}, x as (select road, off0, round(mean, 5) as mean, road % 40 as line from best where rn = 1), y as (select *, row_number() over (partition by line order by mean desc, road, off0) as k from x) select line, road, off0, mean from y where k = 1 order by mean desc, line limit 30",
    "lines_by_identity": """with run as (select o_custkey, year(o_orderdate) as y, sum(o_totalprice) as km, count(*) as stops, max(o_totalprice) as most from orders group by 1, 2)
select * from (select c_mktsegment, c_nationkey, round(sum(km), 2) as km, cast(sum(stops) as bigint) as stops, max(most) as most, count(*) as runs from run join customer on c_custkey = o_custkey group by 1, 2) where km >= 2000 order by km desc, c_mktsegment, c_nationkey limit 40""",
    "component_score": """select l_orderkey, count(*) as n, round(avg(least(greatest((least(l_quantity / 50.0, 1) + 0.5 * least(l_extendedprice / 100000.0, 1) - 0.25 * l_discount * 10 + 2 * least(greatest((l_tax - 0.02) * 20, 0), 1)) / 3.5, 0), 1)), 4) as score from lineitem group by l_orderkey""",
    "bitmask_filter": """with w as (select l_quantity, cast(l_partkey % 15 as int) as class, (case when l_returnflag = 'R' then 1 else 0 end) + (case when l_linestatus = 'F' then 2 else 0 end) + (case when l_suppkey % 4 = 0 then 4 else 0 end) + (case when l_suppkey % 11 = 0 then 8 else 0 end) as flags, l_partkey % 5 as groups from lineitem)
select class, cast(flags as int) as flags, count(*) as n, sum(l_quantity) as length from w where flags & 8 = 0 and (15211 >> class) & 1 = 1 and flags & 2 = 0 and not (flags & 4 > 0 and (5 >> class) & 1 = 1) and round(l_quantity) between 5 and 40
and case when groups <> 0 then groups & 11 > 0 else (11 >> class) & 1 = 1 end group by class, flags""",
    "typical_day": """with n as (select c_mktsegment, cast(o_orderdate as date) as date, count(*) as n from orders join customer on c_custkey = o_custkey where isodow(o_orderdate) between 2 and 4 group by 1, 2),
r as (select *, row_number() over (partition by c_mktsegment order by n, date) - 1 as k, count(*) over (partition by c_mktsegment) as m from n) select c_mktsegment, date, n from r where k = m // 2""",
    "stop_pairs": """with x as (select l_suppkey as a, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as b from lineitem) select least(a, b) as stop_a, greatest(a, b) as stop_b, count(*) as trips from x where b is not null and a <> b group by 1, 2""",
    "headways": """with e as (select distinct event_type, ts from events where hour(ts) between 7 and 18), g as (select event_type, epoch_us(ts) - epoch_us(lag(ts) over (partition by event_type, cast(ts as date) order by ts)) as gap from e)
select g.event_type, median(gap) / 6e7 as headway_min, (select count(distinct cast(ts as date)) from events x where x.event_type = g.event_type) as days from g where gap is not null group by g.event_type""",
    "low_season": """with m as (select o_orderpriority, month(o_orderdate) as month, count(*) as n from orders group by 1, 2), t as (select o_orderpriority, median(n) as mid, count(*) as months from m group by 1)
select m.o_orderpriority, m.month, m.n from m join t using (o_orderpriority) where months >= 6 and m.n < 0.8 * mid""",
}
_CH = ", ".join(f"cast((k * {7 + 2 * i} + {13 * i}) % 256 as double) as c{i}" for i in range(13))
SQL["drive_score"] = f"""with x as (select l_suppkey, l_quantity, l_tax, l_orderkey * 31 + l_linenumber * 17 as k from lineitem), c as (select *, {_CH}, cast((k * 21 + 91) % 256 as int) as fl, cast(k % 60 - 10 as double) as tr, cast(k % 8 as int) as sf from x),
d as (select *, least(c2 / 200, 1) as rel, least(c4 / 100, 1) as cur from c),
s as (select l_suppkey, (c0 / 255 + 0.8 * c1 / 255 + 0.6 * c8 / 255 + 0.5 * rel + 0.3 * least(greatest((c3 - 128) / 30, 0), 1) + 0.4 * cur + 0.2 * (1 - c5 / 255) + 0.3 * c10 / 255 - 0.5 * c6 / 255 - 0.3 * c12 / 255
    + (case when fl & 1 > 0 then 1 else 0 end) + 0.5 * (case when fl & 4 > 0 then 1 else 0 end)) / 5.6 as drive,
  (c0 / 255 + 0.8 * c1 / 255 + 0.6 * c8 / 255 + 0.5 * rel + 0.3 * least(abs(c3 - 128) / 30, 1) + 0.4 * least(greatest((l_quantity * 10 - 3) / 1500, 0), 1) + 0.2 * (case when sf & 2 > 0 then 0.5 else 0 end)
    - 0.3 * (case when sf & 1 > 0 then 1 else 0 end) + 0.5 * least(l_tax * 100 / 4, 1) + 0.3 * cur + 0.7 * (case when tr > 0 then least(log10(greatest(tr, 1)) / 2, 1) else 0 end)) / (4.6 + case when tr > 0 then 0.7 else 0 end) as ride from d)
select l_suppkey, round(avg(least(greatest(drive, 0), 1)), 6) as drive, round(avg(least(greatest(ride, 0), 1)), 6) as ride from s group by l_suppkey"""
SQL["weekday_runs"] = _cycle("event_type, user_id", "isodow(ts)", "events", 7)
SQL["month_runs"] = _cycle("o_custkey, o_orderpriority", "month(o_orderdate)", "orders", 12)
SQL["stage_durations"] = SQL["stage_durations"].replace("{EVENT_CHAIN}", SQL["event_chain"])
SQL["thinned_profile"] = f"""with recursive {_S}, x as (select road, off / 3.6e9 as h, score, row_number() over (partition by road order by off, score) as i, count(*) over (partition by road) as n from s),
y as (select *, (score - lag(score) over w) * (lead(score) over w - score) < 0 as turns from x window w as (partition by road order by i)),
t(road, i, h0, s0, kept) as (select road, i, h, score, true from y where i = 1
  union all select y.road, y.i, case when y.h - t.h0 >= 24 or (turns and abs(y.score - t.s0) > 20) then y.h else t.h0 end, case when y.h - t.h0 >= 24 or (turns and abs(y.score - t.s0) > 20) then y.score else t.s0 end, y.h - t.h0 >= 24 or (turns and abs(y.score - t.s0) > 20)
  from t join y on y.road = t.road and y.i = t.i + 1 where y.i < y.n)
select road, round(h, 6) as h, score from y where i = n or (road, i) in (select road, i from t where kept)"""
SQL["approx_vs_exact"] = f"""with recursive {_BEST}, ex as (select road, run, mean as exact from best where rn = 1),
bx as (select *, row_number() over (partition by road, run order by off, event_id) as k from r),
b(road, run, k, bin, off0) as (select road, run, k, 0, off from bx where k = 1 union all
  select x.road, x.run, x.k, case when x.off - b.off0 < {HOUR} then b.bin else b.bin + 1 end, case when x.off - b.off0 < {HOUR} then b.off0 else x.off end from b join bx x on x.road = b.road and x.run = b.run and x.k = b.k + 1),
bins as (select b.road, b.run, b.bin, b.off0 as o, max(x.off) - b.off0 as l, count(*) as n, avg(x.score) as mean from b join bx x on x.road = b.road and x.run = b.run and x.k = b.k group by 1, 2, 3, 4),
ps as (select road, run, mean, cast(round(case when n > 1 then o + l * q / (n - 1) else o + l / 2 end) as bigint) as off from (select *, unnest(generate_series(0, n - 1)) as q from bins)),
pi as (select *, row_number() over (partition by road, run order by off) as i, sum(mean) over (partition by road, run order by off rows unbounded preceding) as pre from ps),
pj as (select *, min(i) over (partition by road, run order by off range between {LENGTH} following and unbounded following) as j from pi),
pm as (select a.road, a.run, max((q.pre - a.pre + a.mean) / (q.i - a.i + 1)) as approx from pj a join pi q on q.road = a.road and q.run = a.run and q.i = a.j group by 1, 2)
select count(*) as runs, count(*) filter (exact is not null and approx is not null) as in_both, round(max(abs(exact - approx)), 6) as worst, round(avg(abs(exact - approx)), 6) as mean_error from ex full join pm using (road, run)"""
