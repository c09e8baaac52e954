"""Timetable operators: typical days, trips between stops, headways, seasons, service days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(c: Column) -> Column:
    """h:m:s to seconds; hours may exceed 24.  Other forms are null."""
    p = F.split(F.trim(c), ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2))


def service_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, date): the days of calendar rows (flags monday to sunday, start_date, end_date as yyyymmdd) without the
    exceptions of type 2 and with those of type 1.  Rows with unreadable dates give no days."""
    day = lambda c: F.try_to_date(F.trim(F.col(c)), "yyyyMMdd")
    names = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    x = calendar.select("service_id", F.array(*[F.trim(F.col(n)) == "1" for n in names]).alias("runs"), day("start_date").alias("a"), day("end_date").alias("b")).where("a is not null and b >= a")
    x = x.select("service_id", "runs", F.explode(F.sequence("a", "b")).alias("date")).where(F.get("runs", F.weekday("date"))).select("service_id", "date")
    e = exceptions.select("service_id", day("date").alias("date"), F.trim("exception_type").alias("t")).where("date is not null")
    gone = e.where("t = '2'").select("service_id", "date")
    return x.join(gone, ["service_id", "date"], "left_anti").unionByName(e.where("t = '1'").select("service_id", "date")).distinct()


def typical_day(trips: DataFrame, key: str, date: str) -> DataFrame:
    """(key, date, n): the median-busy Tuesday, Wednesday or Thursday; of n days sorted by (count, date) the one at n div 2."""
    n = trips.where(F.weekday(date).between(1, 3)).groupBy(key, date).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    x = n.withColumn("__k", F.row_number().over(w.orderBy("n", date)) - 1).withColumn("__m", F.count("*").over(w))
    return x.where(F.col("__k") == F.floor(F.col("__m") / 2)).select(key, date, "n")


def stop_pairs(stop_times: DataFrame, trip: str, seq: str, stop: str, trips: str | None = None) -> DataFrame:
    """(stop_a, stop_b, trips): how many trips run between two different consecutive stops, in either direction.
    With ``trips`` a row counts that often (frequencies expanded)."""
    w = Window.partitionBy(trip).orderBy(seq)
    x = stop_times.withColumn("__b", F.lead(stop).over(w)).where(F.col("__b").isNotNull() & (F.col("__b") != F.col(stop)))
    n = F.sum(trips) if trips else F.count("*")
    return x.groupBy(F.least(F.col(stop), F.col("__b")).alias("stop_a"), F.greatest(F.col(stop), F.col("__b")).alias("stop_b")).agg(n.alias("trips"))


def expand_frequencies(frequencies: DataFrame) -> DataFrame:
    """(trip_id, start): each departure of frequencies rows (start_time, end_time, headway_secs); the end is not served."""
    x = frequencies.select("trip_id", seconds(F.col("start_time")).alias("a"), seconds(F.col("end_time")).alias("b"), F.col("headway_secs").try_cast("int").alias("h")).where("h > 0 and b > a")
    return x.select("trip_id", F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.col("h"))).alias("start"))


def distinct_trips(trips: DataFrame) -> DataFrame:
    """Trips of several feeds once: same first and last stop to two decimals of a degree, same minutes and mode.
    Columns: feed, trip_id, lon0, lat0, lon1, lat1, start, end (seconds), mode; the smallest (feed, trip_id) stays."""
    key = [F.round(c, 2).alias(c) for c in ("lon0", "lat0", "lon1", "lat1")] + [F.floor(F.col(c) / 60).alias(c) for c in ("start", "end")] + [F.col("mode")]
    return trips.groupBy(*key).agg(F.min(F.struct("feed", "trip_id")).alias("x")).select("x.*")


def headways(df: DataFrame, key: str, ts: str, first: int = 7, last: int = 19) -> DataFrame:
    """(key, headway_min, days): median gap between departures of a day from ``first`` to ``last`` h, and days served."""
    days = df.groupBy(key).agg(F.countDistinct(F.to_date(ts)).alias("days"))
    e = df.where((F.hour(ts) >= first) & (F.hour(ts) < last)).select(key, ts).distinct()
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    g = e.withColumn("__g", us - F.lag(us).over(Window.partitionBy(key, F.to_date(ts)).orderBy(ts))).where("__g is not null")
    return g.groupBy(key).agg((F.percentile("__g", 0.5) / 6e7).alias("headway_min")).join(days, key)


def low_months(df: DataFrame, key: str, date: str, share: float = 0.8, least: int = 6) -> DataFrame:
    """(key, month, n): months with fewer than ``share`` of the median month's, for keys served in ``least`` months or more."""
    m = df.groupBy(key, F.month(date).alias("month")).agg(F.count("*").alias("n"))
    t = m.groupBy(key).agg(F.percentile("n", 0.5).alias("mid"), F.count("*").alias("months"))
    return m.join(t, key).where((F.col("months") >= least) & (F.col("n") < share * F.col("mid"))).select(key, "month", "n")


def seasonal(df: DataFrame, key: str, date: str, gap_days: int = 30) -> DataFrame:
    """(key, seasonal): whether service pauses for ``gap_days`` or more between two days served."""
    x = df.select(key, date).distinct()
    x = x.withColumn("__g", F.datediff(date, F.lag(date).over(Window.partitionBy(key).orderBy(date))))
    return x.groupBy(key).agg(F.coalesce(F.max("__g") >= gap_days, F.lit(False)).alias("seasonal"))


def mode_of(route_type: Column) -> Column:
    """tram, metro, rail, funicular (rack railways and cable cars too), bus, ferry or other of basic and extended route types."""
    t = route_type.try_cast("int")
    return (
        F.when(t.isin(0, 5) | t.between(900, 999), "tram").when(t.isin(1, 12) | t.between(400, 499), "metro").when(t.isin(7, 116, 1400), "funicular")
        .when((t == 2) | t.between(100, 199), "rail").when((t == 4) | (t == 1000) | (t == 1200), "ferry").when((t == 3) | t.between(200, 299) | t.between(700, 799), "bus").otherwise("other")
    )


#: The year in which days of calendars without a year are counted (fixed value).
REF_YEAR = 2001


def month_day(c: Column) -> Column:
    """A date's month and day in REF_YEAR, whatever its year; 29 February is the 28th, unreadable ones are null."""
    t = F.trim(c)
    m, d = F.substring(t, -4, 2).try_cast("int"), F.substring(t, -2, 2).try_cast("int")
    return F.try_to_date(F.format_string("%d-%02d-%02d", F.lit(REF_YEAR), m, F.when((m == 2) & (d == 29), 28).otherwise(d)), "yyyy-MM-dd")


def yearly_dates(calendar: DataFrame) -> DataFrame:
    """(service_id, date): the days of REF_YEAR of calendars without a year (as service_dates, read as months and days); a span that begins
    after it ends goes over the new year."""
    names = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    day = lambda m, d: F.make_date(F.lit(REF_YEAR), F.lit(m), F.lit(d))
    x = calendar.select("service_id", F.array(*[F.trim(F.col(n)) == "1" for n in names]).alias("runs"), month_day(F.col("start_date")).alias("a"), month_day(F.col("end_date")).alias("b")).where("a is not null and b is not null")
    spans = F.when(F.col("a") <= F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct(day(1, 1).alias("a"), F.col("b")), F.struct(F.col("a"), day(12, 31).alias("b"))))
    x = x.select("service_id", "runs", F.explode(spans).alias("s")).select("service_id", "runs", F.explode(F.sequence("s.a", "s.b")).alias("date"))
    return x.where(F.get("runs", F.weekday("date"))).select("service_id", "date").distinct()


def timetable_star(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, dates: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(route_id, mode, trip_id, stop_id, seq, lon, lat, at, per_day): the calls of all trips with how often a trip runs on a day of service.

    Joins of the feed's tables: routes to trips to calls to stops; trips without a day of service are left out; one with frequencies runs once per
    departure.  dates: service_id, date."""
    runs = dates.select("service_id").distinct()
    often = expand_frequencies(frequencies).groupBy("trip_id").agg(F.count("*").alias("per_day"))
    t = trips.select("trip_id", "route_id", "service_id").join(runs, "service_id", "left_semi").join(routes.select("route_id", mode_of(F.col("route_type")).alias("mode")), "route_id").join(often, "trip_id", "left")
    calls = stop_times.select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("seq"), seconds(F.coalesce("departure_time", "arrival_time")).alias("at")).where("seq is not null")
    places = stops.select("stop_id", F.col("stop_lon").try_cast("double").alias("lon"), F.col("stop_lat").try_cast("double").alias("lat"))
    return t.join(calls, "trip_id").join(places, "stop_id").select("route_id", "mode", "trip_id", "stop_id", "seq", "lon", "lat", "at", F.coalesce("per_day", F.lit(1).cast("long")).alias("per_day"))


def ferry_ends(lines: DataFrame, calls: DataFrame, most_m: float = 400.0, share: float = 0.3) -> DataFrame:
    """(line, trip, from_stop, to_stop, at): trips that call at both ends of a ferry line, in the direction they run.

    lines: line, ax, ay, bx, by (metres); calls: trip, stop, seq, at, x, y.  A stop is at an end within ``most_m`` or ``share`` of the ends' separation,
    whichever is less; of a trip's calls at an end the first counts.  Joined by cells of ``most_m``."""
    cell = lambda c: F.floor(c / most_m)
    reach = F.least(F.lit(most_m), share * F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    ends = lines.select("line", reach.alias("reach"), F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("ax").alias("ex"), F.col("ay").alias("ey")), F.struct(F.lit(1).alias("end"), F.col("bx").alias("ex"), F.col("by").alias("ey")))).alias("e")).select("line", "reach", "e.*")
    around = F.explode(F.array(*[F.struct((cell(F.col("ex")) + i).alias("cx"), (cell(F.col("ey")) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    stops = calls.select("stop", "x", "y").distinct().withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y")))
    near = ends.select("line", "end", "ex", "ey", "reach", around.alias("c")).select("line", "end", "ex", "ey", "reach", "c.cx", "c.cy").join(stops, ["cx", "cy"]).where(F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")) <= F.col("reach")).select("line", "end", "stop")
    first = near.join(calls.select("trip", "stop", "seq", "at"), "stop").groupBy("line", "trip", "end").agg(F.min(F.struct("seq", "stop", "at")).alias("c"))
    both = first.groupBy("line", "trip").agg(F.max(F.when(F.col("end") == 0, F.col("c"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("c"))).alias("b")).where("a is not null and b is not null and a.seq <> b.seq")
    ahead = F.col("a.seq") < F.col("b.seq")
    return both.select("line", "trip", F.when(ahead, F.col("a.stop")).otherwise(F.col("b.stop")).alias("from_stop"), F.when(ahead, F.col("b.stop")).otherwise(F.col("a.stop")).alias("to_stop"), F.when(ahead, F.col("a.at")).otherwise(F.col("b.at")).alias("at"))


def service_stats(trips: DataFrame, line: str, way: str, date: str) -> DataFrame:
    """(line, daily, per_day, weekdays): how often a line runs.  ``trips``: one row per sailing, with the direction ``way`` and its date.

    Both directions are averaged where both run.  A line is daily when its median week has four days or more and its median day one sailing or more: then
    per_day is that of the median day, else the median week's sailings over seven.  weekdays: those (1 Monday .. 7) served in at least half of the weeks."""
    weeks = F.date_trunc("week", F.col(date))
    ways = trips.groupBy(line).agg(F.countDistinct(way).alias("ways"))
    t = trips.select(line, F.to_date(date).alias("d"), weeks.alias("w"))
    day = t.groupBy(line, "d", "w").agg(F.count("*").alias("n")).join(ways, line).withColumn("n", F.col("n") / F.col("ways"))
    week = day.groupBy(line, "w").agg(F.count("*").alias("days"), F.sum("n").alias("n"))
    m = day.groupBy(line).agg(F.percentile("n", 0.5).alias("day")).join(week.groupBy(line).agg(F.percentile("days", 0.5).alias("days"), F.percentile("n", 0.5).alias("week"), F.count("*").alias("weeks")), line)
    daily = (F.col("days") >= 4) & (F.col("day") >= 1)
    served = day.select(line, "w", (F.weekday("d") + 1).alias("weekday")).distinct().groupBy(line, "weekday").agg(F.count("*").alias("k"))
    often = served.join(m.select(line, "weeks"), line).where("k * 2 >= weeks").groupBy(line).agg(F.array_sort(F.collect_set("weekday")).alias("weekdays"))
    return m.join(often, line, "left").select(line, daily.alias("daily"), F.when(daily, F.col("day")).otherwise(F.col("week") / 7).alias("per_day"), F.concat_ws("", F.transform(F.coalesce("weekdays", F.array().cast("array<int>")), lambda x: x.cast("string"))).alias("weekdays"))
