"""Network queries on the test tables: customers and orders stand for ways and their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import corridors as C
from wayline.operators import network as N
from wayline.session import table


def ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways between nodes 0..n of a ring of crossings, from the orders."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.lit(2).alias("kind"), (k % 3).cast("int").alias("class"), (k % 17 == 0).alias("oneway"), F.when(k % 4 > 0, F.concat(F.lit("R"), (k / 40).cast("int"))).alias("name"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("A"), (k / 100).cast("int")))).otherwise(F.array().cast("array<string>")).alias("refs"),
        (k % 6000).alias("node0"), ((k + 1) % 6000).alias("node1"), (k * 0.61 % 6.28).alias("heading0"), ((k * 0.61 + 3.0 + (k % 7) * 0.1) % 6.28).alias("heading1"), (F.col("o_totalprice") / 100).alias("length"),
    )


def way_pairs(spark: SparkSession, d: str) -> DataFrame:
    """R1."""
    return N.pair_ends(ways(spark, d))


def chained_roads(spark: SparkSession, d: str) -> DataFrame:
    """R2."""
    x = N.chain_roads(ways(spark, d))
    return x.select("id", "road", F.round("road_length", 4).alias("road_length"), F.round("offset", 4).alias("offset"), "reverse")


def relaxed_heights(spark: SparkSession, d: str) -> DataFrame:
    """Bridges of six orders' nodes, their ends held."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    e = o.select(k.alias("a"), (k + 1).alias("b"), (F.col("o_totalprice") / 1000 + 1).alias("length"), F.when(k % 6 == 0, k * 0.5).alias("height_a"), F.when((k + 1) % 6 == 0, (k + 1) * 0.5).alias("height_b")).where(k % 6 < 5)
    return N.relax_structures(e).select("node", F.round("height", 3).alias("height"), "fixed")


def track_routes(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest tracks between stops of a region (nation and block of 3,000 customers, so that regions grow in number, not in size)."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").withColumn("region", F.concat_ws("/", "c_nationkey", F.floor(k / 3000)))
    e = c.select("region", (k % 40).alias("a"), (k * 7 % 40).alias("b"), (F.abs("c_acctbal") + 1).alias("cost")).where("a <> b")
    p = c.select("region", F.lit(1).alias("a"), (k % 40).alias("b"), F.lit(2000.0).alias("straight")).where("b <> 1").distinct()
    return N.route_pairs(e, p, "region").select("a", "b", F.round("cost", 2).alias("cost"))


def shared_borders(spark: SparkSession, d: str) -> DataFrame:
    """provinces' borders, ends rounded to a hundredth."""
    return N.shared_borders(_rounded_provs(spark, d))


def border_arcs(spark: SparkSession, d: str) -> DataFrame:
    """The arcs of the provinces' borders: their edges, and their points after simplification by a tenth of a degree."""
    arcs = N.border_arcs(N.shared_borders(_rounded_provs(spark, d)))
    lines = N.simplified_arcs(arcs, 10.0).select("arc", "left", "right", F.size("line").alias("kept"))
    return arcs.groupBy("arc").agg(F.count("*").alias("edges")).join(lines, "arc")


def _rounded_provs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "provs").select(F.col("prov").alias("region"), F.transform("ring", lambda q: F.struct(F.round(q["lon"] * 100).cast("int").alias("lon"), F.round(q["lat"] * 100).cast("int").alias("lat"))).alias("ring"))
    return p


def tile_reach(spark: SparkSession, d: str) -> DataFrame:
    """R9."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("tile"), (F.col("c_custkey") * 7919 % 36000).alias("lon"), (F.col("c_custkey") * 104729 % 17000).alias("lat"))
    return N.reach(c, "tile", "lon", "lat")


def station_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Routes are orders, stops their parts' sizes."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("route"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), (F.col("l_partkey") % 50).alias("stop"), F.lit(60.0).alias("km"))
    return N.station_spacing(li, "route", "seq", "stop", "km", 40.0).select("stop", F.round("spacing", 6).alias("spacing"))


def frontages(spark: SparkSession, d: str) -> DataFrame:
    """Customers as samples, suppliers and parts as buildings."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    s = table(spark, d, "customer").select(k.alias("id"), (k * 7919 % 4000).cast("double").alias("x"), (k * 104729 % 4000).cast("double").alias("y"), (k % 6).cast("double").alias("heading"), (k % 11 == 0).alias("hidden"))
    x, y = (p * 6007 % 4000).cast("double"), (p * 3001 % 4000).cast("double")
    b = table(spark, d, "part").select(x.alias("x0"), y.alias("y0"), (x + F.col("p_size")).alias("x1"), (y + 8.0).alias("y1"))
    return C.frontage(s, b).select("id", F.round("share", 6).alias("share"))


def parallel_tracks(spark: SparkSession, d: str) -> DataFrame:
    """J16."""
    k = F.col("p_partkey")
    pts = table(spark, d, "part").select((k % 97).alias("track"), (k * 6007 % 3000).cast("double").alias("x"), (k * 3001 % 3000).cast("double").alias("y"), (k % 6).cast("double").alias("heading"), (F.col("p_size") % 3).alias("service"))
    return C.parallel_tracks(pts)


def merged_stops(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a segment and nation as stops of one name."""
    k = F.col("c_custkey")
    s = table(spark, d, "customer").select(k.alias("id"), F.when(k % 7 > 0, F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("name"), (k * 7919 % 5000).alias("x"), (k * 104729 % 5000).alias("y"))
    return C.merge_stops(s)


def thinned_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pieces of a tile, their items' sizes as cells."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 200).cast("int")).alias("cells"))
    x = x.select((F.col("l_orderkey") % 50).alias("tile"), F.col("l_orderkey").alias("ord"), "cells")
    return C.thin_pieces(x, "tile", "ord", "cells").select("tile", "ord")


def site_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Customers as sites (one in five a part of the one before it), orders as relations, line items as ways."""
    sites = table(spark, d, "customer").where("c_custkey % 5 <> 1").select(F.col("c_custkey").alias("site"), F.abs("c_acctbal").alias("area"))
    parts = table(spark, d, "customer").where("c_custkey % 5 = 1").select(F.col("c_custkey").alias("part"), (F.col("c_custkey") - 1).alias("site"))
    rel = table(spark, d, "orders").select(F.col("o_orderkey").alias("relation"), F.col("o_custkey").alias("ref"), (F.col("o_totalprice") / 20).alias("area"))
    mem = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("relation"), F.col("l_partkey").alias("way"))
    return C.site_outlines(sites, parts, rel, mem)


QUERIES = {f.__name__: f for f in (way_pairs, chained_roads, relaxed_heights, track_routes, shared_borders, border_arcs, tile_reach, station_spacing, frontages, parallel_tracks, merged_stops, thinned_pieces, site_outlines)}

_WAYS = """w as (select o_orderkey as id, o_orderkey % 3 as class, o_orderkey % 17 = 0 as oneway, case when o_orderkey % 4 > 0 then 'R' || (o_orderkey // 40) else '' end as name,
case when o_orderkey % 5 = 0 then 'A' || (o_orderkey // 100) end as ref, o_orderkey % 6000 as n0, (o_orderkey + 1) % 6000 as n1, cast(o_orderkey as double) * 0.61 % 6.28 as h0, (cast(o_orderkey as double) * 0.61 + 3.0 + (o_orderkey % 7) * 0.1) % 6.28 as h1 from orders),
e as (select id, class, oneway, name, ref, 0 as en, n0 as node, h0 as h from w union all select id, class, oneway, name, ref, 1, n1, h1 from w),
p as (select a.node, a.id, a.en, b.id as id2, b.en as en2,
  case when a.ref is not null and b.ref is not null then case when a.ref = b.ref then 3 end when a.name <> '' and a.name = b.name then 2
    when a.class = b.class and a.name = '' and a.ref is null and b.name = '' and b.ref is null then 1 when a.class = b.class and (a.name = '' and a.ref is null) <> (b.name = '' and b.ref is null) then 0 end as lv,
  abs(a.h + pi() - b.h) % (2 * pi()) as off, ((not a.oneway or a.en = 1) and (not b.oneway or b.en = 0)) or ((not b.oneway or b.en = 1) and (not a.oneway or a.en = 0)) as ok
  from e a join e b on a.node = b.node and a.id <> b.id),
q as (select *, least(off, 2 * pi() - off) as turn from p where lv is not null and ok),
r as (select *, row_number() over (partition by node, id, en order by lv desc, turn, id2, en2) as k from q where turn <= radians(case when lv = 0 then 35 else 100 end)),
best as (select * from r where k = 1)"""
SQL = {
    "way_pairs": f'with {_WAYS} select a.id, cast(a.en as int) as "end", a.id2, cast(a.en2 as int) as end2 from best a join best b on b.node = a.node and b.id = a.id2 and b.en = a.en2 and b.id2 = a.id and b.en2 = a.en',
    "shared_borders": """with r as (select prov, list_transform(ring, lambda q: {'lon': cast(round(q.lon * 100) as int), 'lat': cast(round(q.lat * 100) as int)}) as ring from provs),
e as (select prov, ring[i] as p, ring[i + 1] as q from r, unnest(generate_series(1, 60)) t(i) where i < len(ring)), f as (select *, (p.lon, p.lat) < (q.lon, q.lat) as fwd from e where p <> q)
select case when fwd then p.lon else q.lon end as x0, case when fwd then p.lat else q.lat end as y0, case when fwd then q.lon else p.lon end as x1, case when fwd then q.lat else p.lat end as y1,
min(case when fwd then prov end) as left, min(case when not fwd then prov end) as right from f group by 1, 2, 3, 4""",
    "tile_reach": "with c as (select c_nationkey as tile, c_custkey * 7919 % 36000 as lon, c_custkey * 104729 % 17000 as lat from customer) select tile, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north, count(*) as n from c group by tile",
    "station_spacing": """with s as (select l_orderkey as route, l_partkey % 50 as stop, lag(l_partkey % 50) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as p from lineitem),
k as (select * from s where p is null or p <> stop), r as (select route, 60.0 / (count(*) - 1) as spacing from k group by route having count(distinct stop) >= 2)
select stop, round(cast(max(spacing) as double), 6) as spacing from (select distinct route, stop from k) join r using (route) where spacing <= 40 group by stop""",
    "frontages": """with s as (select c_custkey as id, cast(c_custkey * 7919 % 4000 as double) as x, cast(c_custkey * 104729 % 4000 as double) as y, cast(c_custkey % 6 as double) as h from customer where c_custkey % 11 <> 0),
b as (select distinct cast(p_partkey * 6007 % 4000 as double) as x0, cast(p_partkey * 3001 % 4000 as double) as y0, p_partkey * 6007 % 4000 + p_size as x1, p_partkey * 3001 % 4000 + 8.0 as y1 from part where p_size * 8.0 >= 15),
p as (select id, h, k, x + cos(h) * k * 5 as px, y + sin(h) * k * 5 as py from s, unnest(generate_series(-10, 10)) t(k)),
j as (select id, k, cos(h) * ((y0 + y1) / 2 - py) - sin(h) * ((x0 + x1) / 2 - px) > 0 as side, max(least(1, greatest(0, (80 - sqrt(pow(greatest(x0 - px, px - x1, 0), 2) + pow(greatest(y0 - py, py - y1, 0), 2))) / 50))) as w
  from p join b on x0 <= px + 80 and x1 >= px - 80 and y0 <= py + 80 and y1 >= py - 80 group by 1, 2, 3),
g as (select id, sum(w) / 42 as share from j group by id) select c_custkey as id, round(coalesce(share, 0), 6) as share from customer left join g on g.id = c_custkey""",
    "parallel_tracks": """with p as (select p_partkey % 97 as track, cast(p_partkey * 6007 % 3000 as double) as x, cast(p_partkey * 3001 % 3000 as double) as y, cast(p_partkey % 6 as double) as h, p_size % 3 as s from part)
select distinct a.track, b.track as other from p a join p b on a.s = b.s and a.track <> b.track and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 40 and least(abs(a.h - b.h) % pi(), pi() - abs(a.h - b.h) % pi()) <= radians(20)""",
    "site_outlines": """with s as (select c_custkey as site, abs(c_acctbal) as area from customer where c_custkey % 5 <> 1), r as (select site, site as ref from s union all select c_custkey - 1, c_custkey from customer where c_custkey % 5 = 1)
select distinct s.site, l_partkey as way from s join r on r.site = s.site join orders on o_custkey = r.ref join lineitem on l_orderkey = o_orderkey where s.area <= 0 or o_totalprice / 20 <= 3 * s.area""",
}
SQL["chained_roads"] = f"""with recursive {_WAYS}, pr as materialized (select a.id, a.en as e, a.id2, 1 - a.en2 as o2 from best a join best b on b.node = a.node and b.id = a.id2 and b.en = a.en2 and b.id2 = a.id and b.en2 = a.en),
len as (select o_orderkey as id, o_totalprice / 100 as m from orders), st as (select id, e from len, (values (0), (1)) t(e)),
wk(id, e, cur, ce, far, low, n, ring) as (select id, e, id, e, cast(0 as double), id, 0, false from st
  union all select w.id, w.e, p.id2, p.o2, case when p.id2 = w.id then w.far else w.far + l.m end, least(w.low, p.id2), n + 1, p.id2 = w.id from wk w join pr p on p.id = w.cur and p.e = w.ce join len l on l.id = p.id2 where not w.ring),
fin as (select id, e, arg_max(cur, n) as last, max(far) as far, min(low) as low, bool_or(ring) as ring from wk group by id, e),
two as (select l.id, l.m, a.last as l0, b.last as l1, a.far as f0, b.far as f1, least(a.low, b.low) as road, a.ring from len l join fin a on a.id = l.id and a.e = 0 join fin b on b.id = l.id and b.e = 1),
rg as (select w.id as m, w.cur, w.ce, w.n, sum(l.m) over (partition by w.id order by w.n rows unbounded preceding) - l.m as off from wk w join two t on t.id = w.id and t.ring and t.road = w.id join len l on l.id = w.cur where w.e = 1 and not w.ring)
select t.id, road, round(t.m + f0 + case when t.ring then 0 else f1 end, 4) as road_length, round(case when t.ring then rg.off when l0 <= l1 then f0 else f1 end, 4) as "offset", case when t.ring then 1 - rg.ce when l0 <= l1 then 0 else 1 end as reverse from two t left join rg on t.ring and rg.m = t.road and rg.cur = t.id"""
SQL["track_routes"] = """with recursive c as (select c_nationkey || '/' || (c_custkey // 3000) as region, c_custkey % 40 as a, c_custkey * 7 % 40 as b, abs(c_acctbal) + 1 as cost from customer),
e as materialized (select region, a, b, cost from c where a <> b union all select region, b, a, cost from c where a <> b),
d(region, node, cost) using key (region, node) as (select distinct region, cast(1 as bigint), cast(0 as double) from c
  union select e.region, e.b, min(d.cost + e.cost) from d join e on e.region = d.region and e.a = d.node left join recurring.d as k on k.region = e.region and k.node = e.b where k.cost is null or d.cost + e.cost < k.cost group by e.region, e.b)
select '1' as a, cast(d.node as varchar) as b, round(d.cost, 2) as cost from d join (select distinct region, a from c where a <> 1) p on p.region = d.region and p.a = d.node where d.cost <= 9000"""
SQL["thinned_pieces"] = "with c as (select distinct l_orderkey % 50 as tile, l_orderkey as ord, l_partkey % 200 as cell from lineitem) select distinct tile, ord from (select tile, min(ord) as ord from c group by tile, cell)"
