"""Raster and roll-up queries on the test tables: line items as cells of a grid, parts as buildings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.operators import pyramids as P
from wayline.session import table


def cells(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_partkey") % 128).alias("x"), (F.col("l_orderkey") % 64).alias("y")).agg(F.max("l_quantity").alias("height"), (F.count("*") % 4).cast("int").alias("class"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


def pyramid_mean(spark: SparkSession, d: str) -> DataFrame:
    """G26."""
    x = P.mean_levels(cells(spark, d), "height", 5)
    return x.select("level", "x", "y", F.round("value", 6).alias("value"))


def pyramid_majority(spark: SparkSession, d: str) -> DataFrame:
    """Class 1 wins with half of the known."""
    return P.majority_levels(cells(spark, d), "class", 5, 1)


def pyramid_union(spark: SparkSession, d: str) -> DataFrame:
    """G28, A16."""
    x = P.union_levels(cells(spark, d), "flags", 5)
    return x.select("level", "x", "y", F.concat_ws(",", "value").alias("value"))


def elevation_bands(spark: SparkSession, d: str) -> DataFrame:
    """Length by band of ten, by line status."""
    return P.bands(table(spark, d, "lineitem"), F.col("l_extendedprice") / 100, F.col("l_quantity"), 10.0, 255, ["l_linestatus"])


def weighted_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """G36, G39."""
    return P.weighted_quantiles(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"], [0.05, 0.25, 0.5, 0.75, 0.95])


def merged_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Per nation a five-point sketch of balances, merged to a histogram of its distribution."""
    c = table(spark, d, "customer").withColumn("v", (F.col("c_acctbal") + 1000) / 11000)
    s = c.groupBy("c_nationkey").agg(F.array(F.min("v"), F.percentile("v", 0.5), F.max("v")).alias("q"), F.count("*").cast("double").alias("w"))
    x = P.merge_quantile_sketches(s, [], "q", "w", 64)
    return x.select("bin", F.round("weight", 4).alias("weight"))


def height_fill(spark: SparkSession, d: str) -> DataFrame:
    """Parts as buildings."""
    k = F.col("p_partkey")
    b = table(spark, d, "part").select(
        k.alias("id"), ((k * 7919) % 3000).cast("double").alias("x"), ((k * 104729) % 3000).cast("double").alias("y"), (F.col("p_size") * 20).cast("double").alias("area"),
        F.when(k % 3 == 0, (k % 90 * 10).cast("int")).otherwise(0).alias("h_dm"), (k % 6 == 0).alias("est"), F.when(k % 7 == 0, (k % 30).cast("int")).otherwise(0).alias("floors"), (k % 400).cast("int").alias("cell_dm"), (k % 5).cast("int").alias("size_class"),
    )
    known = b.where("h_dm between 20 and 7000 and not est").select("x", "y", "area", F.col("h_dm").alias("h"))
    near = P.neighbour_heights(b.select("id", "x", "y", "area"), known)
    sizes = F.array(*[F.lit(v) for v in (15.0, 3.0, 6.0, 8.0, 11.0)])
    return P.fill_heights(b.join(near, "id", "left"), F.lit(3.0), F.lit(1.5), sizes).select("id", "rule", "height_dm")


def building_runs(spark: SparkSession, d: str) -> DataFrame:
    """Masks as run lengths."""
    return P.row_runs(cells(spark, d).where("class > 0"), [])


def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Tiles from the nearest stored ancestor."""
    c = table(spark, d, "customer")
    asked = c.select(F.lit(8).alias("z"), (F.col("c_custkey") * 31 % 256).alias("x"), (F.col("c_custkey") * 57 % 256).alias("y")).distinct()
    stored = c.select((F.col("c_custkey") % 9).cast("int").alias("z"), "c_custkey").select("z", F.floor(F.col("c_custkey") * 13 % F.pow(F.lit(2), "z")).alias("x"), F.floor(F.col("c_custkey") * 29 % F.pow(F.lit(2), "z")).alias("y"), F.col("c_custkey").alias("v")).groupBy("z", "x", "y").agg(F.min("v").alias("value"))
    return P.from_ancestor(asked, stored, 8)


def finest_zooms(spark: SparkSession, d: str) -> DataFrame:
    """The finest source of each cell."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    src = s.select((k * 7 % 120).alias("west"), (k * 7 % 120 + k % 8).alias("east"), (k * 11 % 60).alias("south"), (k * 11 % 60 + k % 4).alias("north"), (k % 14).cast("int").alias("zoom"))
    return P.finest_zoom(cells(spark, d).select("x", "y"), src)


def _tile_steps(a: np.ndarray) -> dict:
    h = np.nan_to_num(a)
    seen = G.viewshed(h, None, h < 5, 16.0, 16.0, 100.0, 2.0, 1500.0, 256)
    slope, _ = G.slope_direction(h, 100.0)
    return {
        "visible_km2": seen["visible_km2"], "water_km2": seen["water_km2"], "farthest_km": seen["farthest_km"], "share": seen["visible_share"], "steepest": slope.max(),
        "relief": G.landscape(h, 16.0, 16.0, 100.0)["relief"], "far_from_low": min(1e6, G.distance_transform(h < 5).max()), "contour_pieces": len(G.contours(h, 25.0)), "summits": len(__import__("wayline.operators.network", fromlist=["prominence"]).prominence(h)),
    }


def raster_viewshed(spark: SparkSession, d: str) -> DataFrame:
    """Numpy steps over tiles of 32 x 32 cells."""
    c = cells(spark, d).select(F.floor(F.col("x") / 32).alias("tx"), F.floor(F.col("y") / 32).alias("ty"), (F.col("x") % 32).alias("x"), (F.col("y") % 32).alias("y"), "height")
    return P.per_tile(c, ["tx", "ty"], "height", 32, _tile_steps)


def burned_flags(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as triangles and lines burned over one tile."""
    k = F.col("s_suppkey").cast("double")
    x0, y0 = k * 7 % 50, k * 13 % 50
    s = table(spark, d, "supplier").select(
        F.lit(0).alias("tile"), (F.col("s_suppkey") % 8).cast("int").alias("bit"), (F.col("s_suppkey") % 3 == 0).alias("line"),
        F.array(x0, x0 + 9.5, x0 + 3.0, x0).alias("xs"), F.array(y0, y0 + 2.5, y0 + 8.5, y0).alias("ys"),
    )
    return P.burn_polygons(s, 64, 64)


QUERIES = {f.__name__: f for f in (pyramid_mean, pyramid_majority, pyramid_union, elevation_bands, weighted_quantiles, merged_sketches, height_fill, building_runs, nearest_ancestor, finest_zooms, raster_viewshed, burned_flags)}

_C = "c as (select l_partkey % 128 as x, l_orderkey % 64 as y, max(l_quantity) as height, cast(count(*) % 4 as int) as class, list_sort(list_distinct(list(l_returnflag))) as flags from lineitem group by 1, 2)"


def _levels(step: str, n: int = 5) -> str:
    out = []
    for k in range(1, n + 1):
        out.append(step.format(k=k, p=k - 1))
    return ", ".join(out)


_UNION = " union all ".join(f"select {k} as level, x, y, value from l{k}" for k in range(6))
SQL = {
    "pyramid_mean": f"with {_C}, l0 as (select x, y, height as value from c), " + _levels("l{k} as (select x // 2 as x, y // 2 as y, avg(value) as value from l{p} group by 1, 2)") + f" select level, x, y, round(value, 6) as value from ({_UNION})",
    "pyramid_majority": f"with {_C}, l0 as (select x, y, class as value from c), " + _levels("n{k} as (select x // 2 as x, y // 2 as y, value, count(*) as n from l{p} group by 1, 2, 3), l{k} as (select x, y, case when 2 * sum(case when value = 1 then n else 0 end) >= sum(n) then 1 else arg_max(value, (n, -value)) end as value from n{k} group by 1, 2)") + f" {_UNION}",
    "pyramid_union": f"with {_C}, l0 as (select x, y, flags as value from c), " + _levels("l{k} as (select x // 2 as x, y // 2 as y, list_sort(list_distinct(flatten(list(value)))) as value from l{p} group by 1, 2)") + f" select level, x, y, array_to_string(value, ',') as value from ({_UNION})",
    "elevation_bands": "select l_linestatus, cast(least(floor(greatest(l_extendedprice / 100 / 10, 0)), 255) as int) as band, sum(l_quantity) as weight from lineitem group by 1, 2",
    "weighted_quantiles": """with n as (select l_returnflag, l_extendedprice as v, sum(l_quantity) as w from lineitem where l_quantity > 0 group by 1, 2), r as (select *, sum(w) over (partition by l_returnflag order by v rows unbounded preceding) as t, sum(w) over (partition by l_returnflag) as total from n),
s as (select unnest([0.05, 0.25, 0.5, 0.75, 0.95]) as share) select l_returnflag, cast(share as double) as share, min(v) as value from r, s where t >= cast(share as double) * total group by 1, 2""",
    "merged_sketches": """with s as (select c_nationkey, min((c_acctbal + 1000) / 11000) as a, quantile_cont((c_acctbal + 1000) / 11000, 0.5) as b, max((c_acctbal + 1000) / 11000) as c, cast(count(*) as double) as w from customer group by 1),
i as (select w / 2 as w, floor(least(a, 1 - 1e-12) * 64) as p, floor(least(b, 1 - 1e-12) * 64) as q from s union all select w / 2, floor(least(b, 1 - 1e-12) * 64), floor(least(c, 1 - 1e-12) * 64) from s),
x as (select w / (q - p + 1) as w, unnest(generate_series(cast(p as bigint), cast(q as bigint))) as bin from i) select bin, round(sum(w), 4) as weight from x group by bin""",
    "height_fill": """with b as (select p_partkey as k, cast(p_partkey * 7919 % 3000 as double) as x, cast(p_partkey * 104729 % 3000 as double) as y, p_size * 20.0 as area, case when p_partkey % 3 = 0 then p_partkey % 90 * 10 else 0 end as h, p_partkey % 6 = 0 as est,
  case when p_partkey % 7 = 0 then p_partkey % 30 else 0 end as f, p_partkey % 400 as cell, p_partkey % 5 as sc from part),
kn as (select * from b where h between 20 and 7000 and not est),
pr as (select b.k, kn.h, sqrt(pow(b.x - kn.x, 2) + pow(b.y - kn.y, 2)) <= 150 and kn.area between b.area * 0.5 and b.area * 2 as a, b.area >= 60 as c from b join kn on sqrt(pow(b.x - kn.x, 2) + pow(b.y - kn.y, 2)) <= 300),
md as (select k, list_sort(list(h) filter (a)) as la, list_sort(list(h) filter (c)) as lc from pr group by k),
nr as (select k, coalesce(case when len(la) >= 5 then la[(len(la) - 1) // 2 + 1] end, case when len(lc) >= 8 then lc[(len(lc) - 1) // 2 + 1] end) as near from md),
ru as (select b.*, near, case when h between 20 and 7000 and not est then 'measured' when f between 1 and 120 then 'floors' when h between 20 and 7000 then 'estimate' when near is not null then 'neighbours' when cell >= 150 then 'cell' else 'size' end as rule from b left join nr using (k))
select k as id, rule, cast(case rule when 'measured' then h when 'estimate' then h when 'floors' then round(least(greatest(3.0 * f + 1.5, 2), 700) * 10) when 'neighbours' then near when 'cell' then case when area < 200 then least(cell, 250) else cell end
  else round([15.0, 3.0, 6.0, 8.0, 11.0][sc + 1] * 10) end as int) as height_dm from ru""",
    "building_runs": f"with {_C}, r as (select y, x, x - row_number() over (partition by y order by x) as g from c where class > 0) select y, min(x) as x0, max(x) as x1 from r group by y, g",
    "nearest_ancestor": """with asked as (select distinct 8 as z, c_custkey * 31 % 256 as x, c_custkey * 57 % 256 as y from customer), s0 as (select cast(c_custkey % 9 as int) as z, c_custkey as v from customer),
st as (select z, cast(v * 13 % pow(2, z) as bigint) as x, cast(v * 29 % pow(2, z) as bigint) as y, min(v) as value from s0 group by 1, 2, 3)
select a.z, a.x, a.y, arg_max(value, st.z) as value, max(st.z) as from_z from asked a join st on st.x = a.x // cast(pow(2, 8 - st.z) as bigint) and st.y = a.y // cast(pow(2, 8 - st.z) as bigint) group by 1, 2, 3""",
    "finest_zooms": f"with {_C}, s as (select s_suppkey * 7 % 120 as w, s_suppkey * 7 % 120 + s_suppkey % 8 as e, s_suppkey * 11 % 60 as b, s_suppkey * 11 % 60 + s_suppkey % 4 as t, s_suppkey % 14 as zoom from supplier) select c.x, c.y, cast(coalesce(max(zoom), 0) as int) as zoom from c left join s on c.x between w and e and c.y between b and t group by 1, 2",
}
SQL["burned_flags"] = """with s as (select s_suppkey % 8 as bit, s_suppkey % 3 = 0 as line, s_suppkey as id, cast(s_suppkey * 7 % 50 as double) as x, cast(s_suppkey * 13 % 50 as double) as y from supplier),
e as (select id, bit, line, x as x0, y as y0, x + 9.5 as x1, y + 2.5 as y1 from s union all select id, bit, line, x + 9.5, y + 2.5, x + 3, y + 8.5 from s union all select id, bit, line, x + 3, y + 8.5, x, y from s),
g as (select a.i as cx, b.i as cy from range(0, 64) a(i), range(0, 64) b(i)),
f as (select cx, cy, bit from e join g on not line and (y0 > cy + 0.5) <> (y1 > cy + 0.5) and cx + 0.5 < (x1 - x0) * (cy + 0.5 - y0) / (y1 - y0) + x0 group by id, bit, cx, cy having count(*) % 2 = 1),
l as (select cx, cy, bit from e join g on line and cx between least(x0, x1) - 1 and greatest(x0, x1) and cy between least(y0, y1) - 1 and greatest(y0, y1)
  where least(1, greatest((cx - x0) / (x1 - x0), (cx + 1 - x0) / (x1 - x0)), greatest((cy - y0) / (y1 - y0), (cy + 1 - y0) / (y1 - y0))) - greatest(0, least((cx - x0) / (x1 - x0), (cx + 1 - x0) / (x1 - x0)), least((cy - y0) / (y1 - y0), (cy + 1 - y0) / (y1 - y0))) > 1e-12)
select 0 as tile, cast(cx as int) as x, cast(cy as int) as y, cast(bit_or(cast(1 << bit as int)) as int) as bits from (select distinct * from (select * from f union all select * from l)) group by cx, cy"""
