"""Landmark queries on the test tables: customers stand for landmarks (kind = market segment, fame from the balance,
place from the key), suppliers for points of interest, parts for rows with filter values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import scoring as S
from wayline.functions import tiles
from wayline.operators import landmarks as L
from wayline.operators import registers as R
from wayline.operators.spatial import haversine_m
from wayline.session import table


def lon(key):
    return (F.col(key) * 7919 % 36000) / 100 - 180


def lat(key):
    return (F.col(key) * 104729 % 17000) / 100 - 85


def marks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"), "c_nationkey", lon("c_custkey").alias("lon"), lat("c_custkey").alias("lat"),
        F.log10(1 + F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("fa"), (F.col("c_custkey") * 37 % 2000 + 1).cast("double").alias("ia"),
    )


def _points(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.struct(lon(key).alias("lon"), lat(key).alias("lat")).alias("pos"))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """512 bins of the landmark score at balance 0.25."""
    m = marks(spark, d)
    return L.histogram(m, S.landmark_score(m["fa"], m["ia"], 0.25), 0.0, 1.0, 512)


def filter_histograms(spark: SparkSession, d: str) -> DataFrame:
    """P13, P16, G7."""
    p = table(spark, d, "part")
    size, retail, year = F.col("p_size").cast("double"), F.col("p_retailprice"), 1500.0 + F.col("p_partkey") % 500
    f = {
        "size": (S.filter_axis(size, "linear"), L.range_filter(size, 5, 40, False), 0.0, 64.0), "price": (S.filter_axis(retail, "log"), L.range_filter(retail, 950.0, 1800.0, False), 2.5, 3.5),
        "year": (S.filter_axis(year, "year"), L.range_filter(year, 1600, None, True), -2.75, -1.25),
        "parity": ((F.col("p_partkey") % 7).cast("double"), L.flag_filter(F.col("p_partkey") % 7, 0b101, True), 0.0, 8.0),
    }
    return L.filter_histograms(p, f, 128)


def rank_scores(spark: SparkSession, d: str) -> DataFrame:
    """G9."""
    m = marks(spark, d)
    x = L.score_at_ranks(m.select((F.round(S.landmark_score(m["fa"], m["ia"], 0.5), 8)).alias("score")), "score", [1, 10, 100, 1000])
    return x.select("rank", F.round("score", 6).alias("score"))


def top_per_kind(spark: SparkSession, d: str) -> DataFrame:
    """L4, L5, G8."""
    m = marks(spark, d).withColumn("score", F.round(S.landmark_score(F.col("fa"), F.col("ia"), 0.25), 6))
    return L.top_per_kind(m, "kind", [F.desc("score"), F.asc("id")], 10).select("kind", "place", "id", "score")


def top_overall(spark: SparkSession, d: str) -> DataFrame:
    """L4: score, then kind, then rank."""
    m = marks(spark, d).withColumn("score", F.round(S.landmark_score(F.col("fa"), F.col("ia"), 0.25), 6))
    return m.orderBy(F.desc("score"), "kind", "id").limit(50).select("kind", "id", "score")


def kind_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rows the filter keeps, the best of each kind."""
    m = marks(spark, d)
    keep = L.range_filter(m["fa"], 3.0, 3.9, True)
    return m.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(keep, 1)).alias("passing"), F.max_by("id", F.struct("fa", -F.col("id"))).alias("best"), F.round(F.max("fa"), 6).alias("fa"))


def keep_zoom(spark: SparkSession, d: str) -> DataFrame:
    """W15, W16."""
    m = marks(spark, d).withColumn("size", F.when(F.col("id") % 3 > 0, F.col("id") * 31 % 997).cast("double"))
    return L.keep_zoom(m, "kind", "lon", "lat", "fa", "ia", "id", 3, sizes=["size"], keep_size=1).select("kind", "id", "kz")


def speck_cells(spark: SparkSession, d: str) -> DataFrame:
    """Zoom 2, cells of zoom 8."""
    return L.speck_cells(marks(spark, d), "lon", "lat", 2, 6, ["kind"])


def rank_in_kind(spark: SparkSession, d: str) -> DataFrame:
    """W15."""
    return L.rank_from_below(marks(spark, d), ["kind"], "fa", "id").select("kind", "id", "rank")


def nearest_better(spark: SparkSession, d: str) -> DataFrame:
    """J8."""
    x = L.nearest_better(marks(spark, d), ["kind"], "id", "lon", "lat", "fa")
    return x.select("kind", "id", F.round("km", 4).alias("km"))


def held_back(spark: SparkSession, d: str) -> DataFrame:
    """Repeated names; a name is the nation's here."""
    m = marks(spark, d).withColumn("name", F.concat(F.lit(" Place "), F.col("c_nationkey")))
    return L.held_back(m, ["kind"], "name", "id", "lon", "lat", "fa", 1500.0)


def label_zooms(spark: SparkSession, d: str) -> DataFrame:
    """W17."""
    return nearest_better(spark, d).select("kind", "id", L.label_zoom(F.col("km")).alias("zoom"))


def within_distance(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks with a supplier within 200 km."""
    return L.exists_within(_points(table(spark, d, "customer"), "c_custkey"), _points(table(spark, d, "supplier"), "s_suppkey"), 200_000.0)


def nearest_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The four nearest suppliers within 2,000 km."""
    x = L.nearest_k(_points(table(spark, d, "customer"), "c_custkey"), _points(table(spark, d, "supplier"), "s_suppkey"), 2_000_000.0, 4)
    return x.select("a_id", "b_id", F.round("metres", 1).alias("metres"), "place")


def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    """G21."""
    x = table(spark, d, "part").withColumn("v", F.when(F.col("p_size") > 3, F.col("p_size").cast("double")))
    return L.rank_by_counts(x, "v").select("p_partkey", F.round("share", 6).alias("share"))


def fame_values(spark: SparkSession, d: str) -> DataFrame:
    """Mean monthly views of an article (a part's quantity by month) as fame."""
    v = table(spark, d, "lineitem").groupBy("l_partkey", F.date_trunc("month", "l_shipdate").alias("m")).agg(F.sum("l_quantity").alias("views"))
    x = v.groupBy("l_partkey").agg((F.sum("views") / 12).alias("mean"), F.count("*").alias("months"))
    return x.select("l_partkey", F.round(S.fame(F.col("mean"), F.col("months")), 6).alias("fame"))


def tier_defaults(spark: SparkSession, d: str) -> DataFrame:
    """P14, P17."""
    p = table(spark, d, "part").select("p_partkey", S.heritage_tier(F.when(F.col("p_size") % 4 == 0, F.lit("w.c")), F.col("p_size") % 7).alias("tier"))
    return p.where(~F.col("tier").isin("n.lower")).groupBy("tier").agg(F.count("*").alias("n"))


def tile_functions(spark: SparkSession, d: str) -> DataFrame:
    """The tile functions: keys, neighbours, Mercator there and back."""
    m = marks(spark, d)
    x, y = tiles.tile_x(m["lon"], 6), tiles.tile_y(m["lat"], 6)
    back = haversine_m(m["lon"], m["lat"], tiles.mercator_lon(tiles.mercator_x(m["lon"])), tiles.mercator_lat(tiles.mercator_y(m["lat"])))
    return m.select("id", x.alias("x"), y.alias("y"), tiles.tile_key(F.lit(6), x, y).alias("key"), F.size(tiles.neighbour_tiles(x, y, 6)).alias("near"), (back < 0.01).alias("same"))


OUTLINES = {
    "europe": [(-10.0, 35.0), (40.0, 35.0), (40.0, 70.0), (15.0, 60.0), (-10.0, 70.0)], "dateline": [(170.0, -40.0), (-160.0, -40.0), (-160.0, 10.0), (170.0, 10.0)], "pole": [(x * 30.0 - 180.0, 70.0) for x in range(12)],
}


def in_view(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks in a view's outline, in one over the date line and in one round the pole."""
    m = marks(spark, d)
    out = None
    for name, ring in OUTLINES.items():
        x = m.where(R.view_holds(ring, m["lon"], m["lat"])).groupBy().agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(name).alias("view"), "n", "ids")
        out = x if out is None else out.unionByName(x)
    return out


def translation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A document's first language of its list that has a line for its source; of lines of one name the latest counts."""
    doc = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("name"), F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang")).where("name is not null and lang is not null")
    lines = doc.select("name", "lang", F.concat_ws(":", "name", F.col("doc_id").cast("string")).alias("text"), F.lit(0).alias("file"), F.col("doc_id").alias("line"))
    asks = doc.select("doc_id", "name", F.array(F.lit("ja"), F.col("lang"), F.lit("en")).alias("langs"))
    return R.first_translation(asks, lines, "doc_id").select("doc_id", "lang", "text")


def anti_report(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no line item of the last days of a month orders."""
    used = table(spark, d, "lineitem").where(F.dayofmonth("l_shipdate") > 29).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_brand")


def fact_reducers(spark: SparkSession, d: str) -> DataFrame:
    """Facts of items: joined labels, earliest and largest values."""
    o = table(spark, d, "orders")
    facts = o.select(F.col("o_custkey").alias("item"), F.lit("priority").alias("k"), F.col("o_orderpriority").alias("v")).unionByName(o.select(F.col("o_custkey").alias("item"), F.lit("price").alias("k"), F.col("o_totalprice").cast("string").alias("v"))).unionByName(o.select(F.col("o_custkey").alias("item"), F.lit("date").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("v")))
    return R.reduce_facts(facts, "item", labels=["priority"], earliest=["date"], largest=["price"], least=["price"])


def fuzzy_merge(spark: SparkSession, d: str) -> DataFrame:
    """Federal places and items of one province and area that share most words of their names."""
    f = table(spark, d, "federal").where("name is not null and area is not null").dropDuplicates(["id"]).select(F.col("id").alias("a"), R.name_words("name").alias("wa"), F.lower(F.trim("area")).alias("cell"))
    w = table(spark, d, "wditems").where("name_en is not null and place is not null").select(F.col("item").alias("b"), R.name_words("name_en").alias("wb"), F.lower(F.trim("place")).alias("cell")).distinct()
    return R.shared_words(f, w, 0.75)


def connected_groups(spark: SparkSession, d: str) -> DataFrame:
    """Connected groups of parts and the orders that hold them, over all line items."""
    li = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("a"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("b"))
    return R.connected(li).select("id", "root")


def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id rule: rows that would share an id get the next free suffix in order."""
    p = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("-"), F.col("p_size")).alias("wanted"))
    return R.assign_ids(p, "wanted", "p_partkey")


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Sets of tiles seen by two kinds of points: both, one only, all."""
    m = marks(spark, d).withColumn("t", tiles.tile_key_at(F.col("lon"), F.col("lat"), F.lit(3)))
    a, b = m.where("kind = 'BUILDING'").select("t"), m.where("kind = 'MACHINERY'").select("t")
    parts = {"both": a.intersect(b), "first_only": a.subtract(b), "all": a.union(b).distinct()}
    out = None
    for k, x in parts.items():
        y = x.agg(F.count("*").alias("n"), F.sum(F.col("t") % 1000003).alias("h")).select(F.lit(k).alias("set"), "n", "h")
        out = y if out is None else out.unionByName(y)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        score_histogram, filter_histograms, rank_scores, top_per_kind, top_overall, kind_totals, keep_zoom, speck_cells, rank_in_kind, nearest_better, held_back, label_zooms, within_distance, nearest_tracks, percentile_rank,
        fame_values, tier_defaults, tile_functions, in_view, translation_lookup, anti_report, fact_reducers, fuzzy_merge, connected_groups, unique_ids, set_operations,
    )
}

def view_sql(ring: list[tuple[float, float]], lon: str = "lon", lat: str = "lat") -> str:
    """Whether a point is inside an outline: on the stereographic plane centred on the outline, by the number of edges that a ray crosses."""
    vec = [(math.cos(math.radians(b)) * math.cos(math.radians(a)), math.cos(math.radians(b)) * math.sin(math.radians(a)), math.sin(math.radians(b))) for a, b in ring]
    c = [sum(v[i] for v in vec) for i in range(3)]
    size = math.sqrt(sum(v * v for v in c))
    lon0, lat0 = math.atan2(c[1], c[0]), math.asin(c[2] / size)

    def flat(a, b):
        a, b = math.radians(a) - lon0, math.radians(b)
        k = 2 / (1 + math.sin(lat0) * math.sin(b) + math.cos(lat0) * math.cos(b) * math.cos(a))
        return k * math.cos(b) * math.sin(a), k * (math.cos(lat0) * math.sin(b) - math.sin(lat0) * math.cos(b) * math.cos(a))

    a, b = f"(radians({lon}) - {lon0!r})", f"radians({lat})"
    near = f"(1 + {math.sin(lat0)!r} * sin({b}) + {math.cos(lat0)!r} * cos({b}) * cos({a}))"
    x, y = f"(2 / {near} * cos({b}) * sin({a}))", f"(2 / {near} * ({math.cos(lat0)!r} * sin({b}) - {math.sin(lat0)!r} * cos({b}) * cos({a})))"
    pts = [flat(*p) for p in ring]
    cross = " + ".join(f"(case when ({q[1]!r} > {y}) <> ({p[1]!r} > {y}) and {x} < {(p[0] - q[0])!r} * ({y} - {q[1]!r}) / {(p[1] - q[1])!r} + {q[0]!r} then 1 else 0 end)" for q, p in zip(pts, pts[1:] + pts[:1]))
    return f"({near} > 1 and ({cross}) % 2 = 1)"


_M = """m as (select c_custkey as id, c_mktsegment as kind, c_nationkey, (c_custkey * 7919 % 36000) / 100.0 - 180 as lon, (c_custkey * 104729 % 17000) / 100.0 - 85 as lat,
log10(1 + greatest(c_acctbal, 0)) as fa, cast(c_custkey * 37 % 2000 + 1 as double) as ia from customer)"""
_SCORE = "((1 - {b}) * least(fa / 5, 1) + {b} * least(greatest((log10(greatest(ia, 0.05)) + 1.3) / 5.6, 0), 1))"
_KM = "2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_SUP = "p as (select s_suppkey as id, (s_suppkey * 7919 % 36000) / 100.0 - 180 as lon, (s_suppkey * 104729 % 17000) / 100.0 - 85 as lat from supplier)"
_TX = "cast(least(greatest(floor((lon + 180) / 360 * {n}), 0), {n} - 1) as bigint)"
_TY = "cast(least(greatest(floor((1 - ln(tan(radians(least(greatest(lat, -85.0511287798066), 85.0511287798066))) + 1 / cos(radians(least(greatest(lat, -85.0511287798066), 85.0511287798066)))) / pi()) / 2 * {n}), 0), {n} - 1) as bigint)"


def _tile(z: int) -> str:
    n = 1 << z
    return f"({z} * 288230376151711744 + {_TX.format(n=n)} * 536870912 + {_TY.format(n=n)})"


_NB = f"nb as (select a.kind, a.id, least(coalesce(min(case when b.id is not null then {_KM} end), 20000), 20000) as km from m a left join m b on a.kind = b.kind and (b.fa > a.fa or (b.fa = a.fa and b.id < a.id)) group by a.kind, a.id)"
_F = """f as (select *, cast(p_size as double) as size, (p_size between 5 and 40) as k_size, log10(p_retailprice) as price, (p_retailprice between 950 and 1800) as k_price, p_partkey % 7 as par, (p_partkey % 7) & 5 > 0 as k_par, -log10(greatest(2030 - (1500 + p_partkey % 500), 1)) as yr, 1500 + p_partkey % 500 >= 1600 as k_yr from part)"""
SQL = {
    "score_histogram": f"with {_M} select cast(least(greatest(floor({_SCORE.format(b=0.25)} * 512), 0), 511) as int) as bin, count(*) as n from m group by 1",
    "filter_histograms": f"""with {_F} select 'size' as filter, cast(least(greatest(floor(size / 64 * 128), 0), 127) as int) as bin, count(*) as n from f where k_price and k_par and k_yr group by 1, 2
union all select 'price', cast(least(greatest(floor((price - 2.5) * 128), 0), 127) as int), count(*) from f where k_size and k_par and k_yr group by 1, 2
union all select 'year', cast(least(greatest(floor((yr + 2.75) / 1.5 * 128), 0), 127) as int), count(*) from f where k_size and k_price and k_par group by 1, 2
union all select 'parity', cast(least(greatest(floor(par / 8 * 128), 0), 127) as int), count(*) from f where k_size and k_price and k_yr group by 1, 2""",
    "rank_scores": f"with {_M}, s as (select round({_SCORE.format(b=0.5)}, 8) as score, row_number() over (order by round({_SCORE.format(b=0.5)}, 8) desc) as k, count(*) over () as n from m), r as (select unnest([1, 10, 100, 1000]) as rank) select cast(rank as int) as rank, round(score, 6) as score from r join s on s.k = least(rank, n)",
    "top_per_kind": f"with {_M}, s as (select *, round({_SCORE.format(b=0.25)}, 6) as score from m), k as (select *, row_number() over (partition by kind order by score desc, id) as place from s) select kind, place, id, score from k where place <= 10",
    "top_overall": f"with {_M} select kind, id, round({_SCORE.format(b=0.25)}, 6) as score from m order by score desc, kind, id limit 50",
    "kind_totals": f"with {_M} select kind, count(*) as n, count(*) filter (fa between 3.0 and 3.9) as passing, arg_max(id, (fa, -id)) as best, round(max(fa), 6) as fa from m group by kind",
    "keep_zoom": f"""with {_M}, s as (select *, case when id % 3 > 0 then cast(id * 31 % 997 as double) end as size from m), z as ({" union all ".join(f"select *, {z} as z, {_tile(z)} as t from s" for z in range(6))}),
r as (select kind, id, z, size, {", ".join(f"row_number() over (partition by kind, t order by {_SCORE.format(b=b)} desc, id) as r{i}" for i, b in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)))}, row_number() over (partition by kind, t order by size desc nulls last, id) as rs from z),
k as (select kind, id, min(z) as kz from r where least(r0, r1, r2, r3, r4) <= 3 or (rs <= 1 and size is not null) group by kind, id)
select m.kind, m.id, cast(coalesce(kz, 6) as int) as kz from m left join k on k.kind = m.kind and k.id = m.id""",
    "speck_cells": f"""with {_M}, c as (select kind, {_TX.format(n=256)} as x, {_TY.format(n=256)} as y from m)
select 2 * 288230376151711744 + (x // 64) * 536870912 + (y // 64) as tile, {" + ".join(f"((x >> {i}) & 1) * {1 << 2 * i} + ((y >> {i}) & 1) * {1 << 2 * i + 1}" for i in range(6))} as cell, kind, count(*) as n from c group by 1, 2, 3""",
    "rank_in_kind": f"with {_M} select kind, id, row_number() over (partition by kind order by fa, id) - 1 as rank from m",
    "nearest_better": f"with {_M}, {_NB} select kind, id, round(km, 4) as km from nb",
    "held_back": f"with {_M} select distinct a.id from m a join m b on a.kind = b.kind and a.c_nationkey = b.c_nationkey and (b.fa > a.fa or (b.fa = a.fa and b.id < a.id)) where {_KM} <= 1500",
    "label_zooms": f"with {_M}, {_NB} select kind, id, greatest(2, least(14, round(2 + log2(2000 / greatest(round(km, 4), 0.05)), 2))) as zoom from nb",
    "within_distance": f"with {_M}, {_SUP} select distinct a.id from m a join p b on {_KM} <= 200",
    "nearest_tracks": f"with {_M}, {_SUP}, d as (select a.id as a_id, b.id as b_id, {_KM} * 1000 as metres from m a, p b), k as (select *, row_number() over (partition by a_id order by metres, b_id) as place from d where metres <= 2000000) select a_id, b_id, round(metres, 1) as metres, place from k where place <= 4",
    "percentile_rank": "with x as (select p_partkey, p_size, cume_dist() over (order by p_size) as share from part where p_size > 3) select p.p_partkey, round(coalesce(x.share, 0), 6) as share from part p left join x on x.p_partkey = p.p_partkey",
    "fame_values": "with v as (select l_partkey, sum(l_quantity) / 12 as mean from lineitem group by 1) select l_partkey, round(log10(1 + mean), 6) as fame from v",
    "tier_defaults": "with t as (select case when p_size % 4 = 0 then 'w.c' else case p_size % 7 when 1 then 'n.top' when 2 then 'n.second' when 3 then 'n.lower' when 4 then 'p.des' else 'm.des' end end as tier from part) select tier, count(*) as n from t where tier <> 'n.lower' group by tier",
    "tile_functions": f"with {_M}, x as (select id, {_TX.format(n=64)} as x, {_TY.format(n=64)} as y from m) select id, x, y, 6 * 288230376151711744 + x * 536870912 + y as key, cast(case when y in (0, 63) then 6 else 9 end as int) as near, true as same from x",
    "translation_lookup": """with d as (select doc_id, lower(trim(source)) as name, lower(substr(trim(lang), 1, 2)) as lang from documents where source is not null and lang is not null),
l as (select name, lang, arg_max(name || ':' || doc_id, doc_id) as text from d group by name, lang),
a as (select doc_id, name, unnest([{'lang': 'ja', 'pos': 0}, {'lang': lang, 'pos': 1}, {'lang': 'en', 'pos': 2}]) as q from d),
h as (select a.doc_id, a.q.pos as pos, l.lang, l.text from a join l on l.name = a.name and l.lang = a.q.lang)
select doc_id, arg_min(lang, pos) as lang, arg_min(text, pos) as text from h group by doc_id""",
    "anti_report": "select p_partkey, p_brand from part where p_partkey not in (select l_partkey from lineitem where day(l_shipdate) > 29)",
    "fact_reducers": """select o_custkey as item, string_agg(distinct o_orderpriority, ' | ' order by o_orderpriority) as priority, min(strftime(o_orderdate, '%Y-%m-%d')) as date_earliest, max(o_totalprice) as price_largest, min(o_totalprice) as price_least from orders group by 1""",
    "fuzzy_merge": r"""with fa as (select id as a, lower(trim(area)) as cell, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-zà-ÿ]+'), lambda x: length(x) >= 3)) as wa from (select id, any_value(name) as name, any_value(area) as area from federal group by id) where name is not null and area is not null),
wb as (select distinct item as b, lower(trim(place)) as cell, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name_en), '[^a-zà-ÿ]+'), lambda x: length(x) >= 3))) as wb from wditems where name_en is not null and place is not null)
select distinct a, b, round(len(list_intersect(wa, wb)) / least(len(wa), len(wb)), 4) as share from fa join wb using (cell) where len(wa) > 0 and len(wb) > 0 and len(list_intersect(wa, wb)) >= 0.75 * least(len(wa), len(wb))""",
    "connected_groups": """with recursive u as materialized (select distinct 'p' || l_partkey as a, 'o' || l_orderkey as b from lineitem union select 'o' || l_orderkey, 'p' || l_partkey from lineitem),
l(id, root) using key (id) as (select a, min(least(a, b)) from u group by a union
  select u.b, min(l.root) from l join u on u.a = l.id join recurring.l as k on k.id = u.b where l.root < k.root group by u.b) select id, root from l""",
    "unique_ids": "select p_partkey, wanted || case when k > 0 then '~' || k else '' end as id from (select p_partkey, p_brand || '-' || p_size as wanted, row_number() over (partition by p_brand || '-' || p_size order by p_partkey) - 1 as k from part)",
    "set_operations": f"""with {_M}, t as (select distinct kind, {_tile(3)} as t from m), a as (select t from t where kind = 'BUILDING'), b as (select t from t where kind = 'MACHINERY'),
s as (select 'both' as set, t from a where t in (select t from b) union all select 'first_only', t from a where t not in (select t from b) union all select 'all', t from (select t from a union select t from b))
select set, count(*) as n, sum(t % 1000003) as h from s group by set""",
}
SQL["in_view"] = f"with {_M} " + " union all ".join(f"select '{k}' as view, count(*) as n, sum(id) as ids from m where {view_sql(r)}" for k, r in OUTLINES.items())
