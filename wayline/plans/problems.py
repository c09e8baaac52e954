"""The pN_ queries of the general problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.clean import mac_name, unix_millis, unix_seconds
from wayline.operators.gridding import clean_readings, empty_slots, regular_grid
from wayline.operators.hierarchy import descendants, edges, hierarchy, latest
from wayline.operators.intervals import merge_intervals, periods_and_gaps
from wayline.operators.spatial import position, region_of, within_distance
from wayline.session import table

FIELDS = {"load": (0, 1000), "memfree": (0, 100), "swap": (0, 1_000_000)}
GAP_MS = 6 * 3600 * 1000
NEAR_M = 300.0


def _placed(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return hierarchy(edges(table(spark, d, "spans"), "id", "parent"), paths)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Spans whose recorded root isn't their top, or whose parents never end."""
    roots = latest(table(spark, d, "spans").where("id is not null and id <> ''"), "id", "seq", "root")
    tree = _placed(spark, d, paths=False).where("has_row").join(roots, "id")
    return tree.where("status <> 'tree' or root <> top").select("id", F.col("top").alias("top_id"))


def p1_tree(spark: SparkSession, d: str) -> DataFrame:
    """Each span's top, depth, path and subtree size."""
    return _placed(spark, d).where("has_row").select("id", F.col("top").alias("top_id"), "depth", F.concat_ws("/", "path").alias("path"), "subtree_size", "status")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All spans below each span, those that hang below a loop too."""
    return descendants(_placed(spark, d))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples")
    return regular_grid(clean_readings(s, mac_name(s["mac"]), unix_seconds(s["t"]), FIELDS), list(FIELDS))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return empty_slots(_grid(spark, d), list(FIELDS)).withColumnRenamed("k", "mac")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    x = _grid(spark, d).withColumnRenamed("k", "mac")
    return x.withColumns({f: F.round(f, 4) for f in FIELDS})


def busy_spans(spark: SparkSession, d: str) -> DataFrame:
    """(mac, a, b) in ms, one row per span id, from whichever of its rows says them."""
    s = table(spark, d, "spans").where("id is not null and id <> ''")
    return s.groupBy("id").agg(F.max(mac_name(s["mac"])).alias("mac"), F.max(unix_millis(s["t0"])).alias("a"), F.max(unix_millis(s["t1"])).alias("b"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    x = periods_and_gaps(busy_spans(spark, d), "mac", "a", "b", GAP_MS)
    return x.select(F.col("k").alias("mac"), "what", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    x = merge_intervals(busy_spans(spark, d), "mac", "a", "b")
    return x.select(F.col("k").alias("mac"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), F.col("n").alias("spans"))


def summit_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "summits").select("id", position(F.col("lon") / 1e7, F.col("lat") / 1e7).alias("pos"))


def sight_points(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.size("lnglat") >= 2, position(F.get("lnglat", F.lit(0)), F.get("lnglat", F.lit(1))))
    return table(spark, d, "sights").select(F.col("sight_id").alias("id"), at.alias("pos"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = within_distance(summit_points(spark, d), sight_points(spark, d), NEAR_M)
    return near.select(F.col("a_id").alias("summit_id"), F.col("b_id").alias("sight_id"))


def item_points(spark: SparkSession, d: str) -> DataFrame:
    """Items with the position of their coordinate text; other forms of text are no position."""
    num = r"(-?[0-9]+(?:\.[0-9]+)?)"
    part = lambda i: F.regexp_extract("coord", rf"^Point\({num} {num}\)$", i).try_cast("double")
    return table(spark, d, "wditems").select(F.col("item").alias("id"), position(part(1), part(2)).alias("pos"))


def p5_province(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "provs").select(F.col("prov").alias("region"), "ring")
    return region_of(item_points(spark, d), regions).select(F.col("id").alias("item"), F.col("region").alias("prov"))


QUERIES = {f.__name__: f for f in (p1_found, p1_tree, p1_descendants, p2_found, p2_grid, p3_found, p3_periods, p5_found, p5_province)}

_SPANS = """edge as (select id, min(case when parent <> '' then parent end) as parent from spans where id <> '' group by id)"""
_WALK = f"""with recursive {_SPANS},
up(id, cur) as (select id, parent from edge where parent is not null
  union select up.id, e.parent from up join edge e on e.id = up.cur where e.parent is not null),
ring as (select id from up where id = cur),
"""
_MAC = r"nullif(regexp_replace(lower(trim(mac, e' \t\n\r ')), '\.local$', ''), '')"
_BUSY = f"""one as (select id, max({_MAC}) as mac, max(cast(round(case when t0 > 1e11 then t0 else t0 * 1000 end) as bigint)) as a,
  max(cast(round(case when t1 > 1e11 then t1 else t1 * 1000 end) as bigint)) as b from spans where id <> '' group by id),
ok as (select mac, a, b from one where mac is not null and b >= a),
run as (select *, max(b) over (partition by mac order by a, b rows between unbounded preceding and 1 preceding) as before from ok),
isl as (select *, sum(case when before is null or a > before then 1 else 0 end) over (partition by mac order by a, b rows unbounded preceding) as g from run),
per as (select mac, min(a) as start_ms, max(b) as end_ms, count(*) as spans from isl group by mac, g)
"""
_POS = """s as (select distinct id, lon / 1e7 as x, lat / 1e7 as y from summits where id is not null and lon is not null and lat is not null and not (lon = 0 and lat = 0)),
g as (select distinct sight_id, ((lnglat[1] + 180) - 360 * floor((lnglat[1] + 180) / 360)) - 180 as x, lnglat[2] as y from sights
  where len(lnglat) >= 2 and lnglat[1] is not null and abs(lnglat[2]) <= 90 and not (lnglat[1] = 0 and lnglat[2] = 0))
"""
_SAMPLE = f"""r as (select {_MAC} as mac, case when t > 1e11 then t / 1000 else t end as t,
  case when not isnan(load) and load between 0 and 1000 then load end as load, case when not isnan(memfree) and memfree between 0 and 100 then memfree end as memfree,
  case when not isnan(swap) and swap between 0 and 1000000 then swap end as swap from samples where isfinite(t)),
ok as (select *, cast(floor(t / 60) as bigint) as slot from r where mac is not null and coalesce(load, memfree, swap) is not null),
lagged as (select *, lag(t) over (partition by mac order by t) as p from ok),
st as (select *, sum(case when p is null or t - p > 1800 then 1 else 0 end) over (partition by mac order by t rows unbounded preceding) as g from lagged),
minutes as (select distinct mac, unnest(generate_series(a, b)) as slot from (select mac, min(slot) as a, max(slot) as b from st group by mac, g)),
has as (select mac, slot, count(load) as load, count(memfree) as memfree, count(swap) as swap from ok group by mac, slot)
"""
def _field_sql(f: str) -> str:
    """The local line of one field at a slot's middle: weighted means and slopes by their textbook formulas."""
    mean = lambda x: f"sum(w * {x}) filter ({f} is not null) / nullif(sum(w) filter ({f} is not null), 0)"
    return (
        f"count(*) filter (own and {f} is not null) as {f}_n, {mean('u')} as {f}_mu, {mean(f)} as {f}_my, {mean('u * u')} as {f}_muu, {mean('u * ' + f)} as {f}_muy, "
        f"coalesce(pow(sum(w) filter ({f} is not null), 2) / nullif(sum(w * w) filter ({f} is not null), 0), 0) as {f}_sup"
    )


def _pick_sql(f: str) -> str:
    n, sup = f"coalesce({f}_n, 0)", f"coalesce({f}_sup, 0)"
    line = f"case when {f}_sup >= 2 and {f}_muu - {f}_mu * {f}_mu > 1e-6 then {f}_my - ({f}_muy - {f}_mu * {f}_my) / ({f}_muu - {f}_mu * {f}_mu) * {f}_mu else {f}_my end"
    return f"cast({n} as int) as {f}_n, round(case when {n} > 0 or {sup} >= 1.5 then {line} end, 4) as {f}, round({sup}, 4) as {f}_support, case when {n} > 0 then 'measured' when {sup} >= 1.5 then 'filled' else 'missing' end as {f}_mark"


SQL = {
    "p2_grid": "with " + _SAMPLE + """, one as (select mac, t, max(load) as load, max(memfree) as memfree, max(swap) as swap from ok group by mac, t),
near as (select *, cast(floor(t / 60) as bigint) as base from one), sl as (select *, base + k as slot, k = 0 as own, (t - (base + k + 0.5) * 60) / 150 as u from near, (values (-3), (-2), (-1), (0), (1), (2), (3)) v(k)),
ww as (select *, case when abs(u) < 1 then pow(1 - pow(abs(u), 3), 3) else 0 end as w from sl where own or abs(u) <= 1),
g as (select mac, slot, count(*) filter (own) as n, min(t) filter (own) as t_min, max(t) filter (own) as t_max, """ + ", ".join(_field_sql(f) for f in FIELDS) + """ from ww group by mac, slot)
select m.mac, m.slot, (m.slot + 0.5) * 60 as t, """ + ", ".join(_pick_sql(f) for f in FIELDS) + " from minutes m left join g on g.mac = m.mac and g.slot = m.slot",
    "p1_found": _WALK + """last as (select up.id, coalesce(min(case when r.id is not null then up.cur end), max(case when e.parent is null then up.cur end)) as top, count(r.id) as loops
  from up left join edge e on e.id = up.cur left join ring r on r.id = up.cur group by up.id),
recorded as (select id, arg_max(root, seq) as root from spans where id <> '' and root is not null group by id)
select e.id, coalesce(l.top, e.id) as top_id from edge e left join last l on l.id = e.id left join recorded r on r.id = e.id
where coalesce(l.loops, 0) > 0 or r.root <> coalesce(l.top, e.id)""",
    "p1_tree": _WALK + """down(id, top, path, depth) as (select id, id, id, 0 from edge where parent is null
  union all select id, parent, parent || '/' || id, 1 from edge where parent is not null and parent not in (select id from edge)
  union all select e.id, d.top, d.path || '/' || e.id, d.depth + 1 from down d join edge e on e.parent = d.id),
below as (select cur, count(*) as n from up group by cur),
low as (select up.id, min(up.cur) as top from up join ring r on r.id = up.cur group by up.id)
select e.id, coalesce(d.top, low.top) as top_id, cast(d.depth as int) as depth, coalesce(d.path, '') as path, case when r.id is null then 1 + coalesce(b.n, 0) end as subtree_size,
  case when d.id is not null then 'tree' when r.id is not null then 'loop' else 'into_loop' end as status
from edge e left join down d on d.id = e.id left join ring r on r.id = e.id left join low on low.id = e.id left join below b on b.cur = e.id""",
    "p1_descendants": _WALK + """pairs(id, cur, n) as (select id, parent, 1 from edge where parent is not null and id not in (select id from ring) and parent not in (select id from ring)
  union all select p.id, e.parent, n + 1 from pairs p join edge e on e.id = p.cur where e.parent is not null and e.parent not in (select id from ring))
select cur as ancestor, id, cast(n as int) as distance from pairs""",
    "p2_found": "with " + _SAMPLE + """select m.mac, m.slot, f.field from minutes m cross join (values ('load'), ('memfree'), ('swap')) f(field)
left join has h on h.mac = m.mac and h.slot = m.slot
where coalesce(case f.field when 'load' then h.load when 'memfree' then h.memfree else h.swap end, 0) = 0""",
    "p3_found": f"with {_BUSY}, pre as (select *, lag(end_ms) over (partition by mac order by start_ms) as p from per) "
    "select mac, 'busy' as what, start_ms, end_ms from per union all select mac, 'gap', p, start_ms from pre where start_ms - p <= 21600000",
    "p3_periods": f"with {_BUSY} select * from per",
    "p5_found": "with " + _POS + """select distinct s.id as summit_id, g.sight_id from s join g on abs(s.y - g.y) < 0.003
where 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(g.y - s.y) / 2), 2) + cos(radians(s.y)) * cos(radians(g.y)) * pow(sin(radians(g.x - s.x) / 2), 2)))) <= 300""",
    "p5_province": r"""with pt as (select distinct item, cast(regexp_extract(coord, '^Point\((-?[0-9.]+) (-?[0-9.]+)\)$', 1) as double) as x,
  cast(regexp_extract(coord, '^Point\((-?[0-9.]+) (-?[0-9.]+)\)$', 2) as double) as y from wditems where coord like 'Point(%'),
ed as (select prov, ring[i] as a, ring[i + 1] as b from provs, unnest(generate_series(1, len(ring) - 1)) t(i))
select item, prov from pt, ed where (a.lat > y) <> (b.lat > y) and x < (b.lon - a.lon) * (y - a.lat) / (b.lat - a.lat) + a.lon
group by item, prov, x, y having count(*) % 2 = 1""",
}
