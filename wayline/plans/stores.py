"""Lookup, change-log and gate queries on the test tables: orders as entries and batches, customers as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import tags as G
from wayline.operators import lookups as J
from wayline.plans.landmarks import marks
from wayline.session import table
from wayline.streaming import maplog as M


def _pad(c):
    return F.lpad(c.cast("string"), 4, "0")


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of the orders' entries, 250 orders each: key = customer, value = price; cancelled ones are deleted."""
    o = table(spark, d, "orders")
    o = o.select((F.floor(F.col("o_orderkey") / 250) + 1).alias("seq"), F.concat(F.lit("lm/"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"), (F.col("o_custkey") % 500).cast("string")).alias("key"), F.col("o_orderkey"), F.col("o_orderstatus"), F.round("o_totalprice", 2).alias("p"))
    per = o.groupBy("seq", "key").agg(F.max_by(F.struct("o_orderstatus", "p"), "o_orderkey").alias("x"))
    dead = F.col("x.o_orderstatus") == "P"
    return per.groupBy("seq").agg(
        F.map_from_entries(F.collect_list(F.when(~dead, F.struct("key", F.format_string("%.2f", F.col("x.p")))))).alias("set"), F.collect_list(F.when(dead, F.col("key"))).alias("del"),
    ).select("seq", F.lit("").alias("at"), F.lit("t").alias("app"), F.lit("").alias("why"), "set", "del", F.array().cast("array<string>").alias("freed"), F.lit(None).cast("decimal(20,0)").alias("digest"))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], M.NOTHING)


def log_apply(spark: SparkSession, d: str) -> DataFrame:
    """T1, T6, K9."""
    return M.apply_batches(_empty(spark), batches(spark, d))


def log_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same state by a streaming query over batch files, with digests checked."""
    return M.replay(spark, batches(spark, d))


def log_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests after each batch from the changes alone, held against whole states' digests at some of them."""
    b = batches(spark, d)
    inc = M.digests_after(_empty(spark), b).where("seq in (1, 3, 5)")
    whole = None
    for k in (1, 3, 5):
        x = M.digest(M.apply_batches(_empty(spark), b.where(F.col("seq") <= k))).select(F.lit(k).cast("long").alias("seq"), F.col("digest").alias("whole"), "n")
        whole = x if whole is None else whole.unionByName(x)
    return inc.join(whole, "seq").select("seq", "n", (F.col("digest") == F.col("whole")).alias("same"))


def map_diff(spark: SparkSession, d: str) -> DataFrame:
    """From the state after four batches to the state after all."""
    b = batches(spark, d)
    return M.map_diff(M.apply_batches(_empty(spark), b.where("seq <= 4")), M.apply_batches(_empty(spark), b))


def watch_marks(spark: SparkSession, d: str) -> DataFrame:
    """T4."""
    return M.watch_marks(batches(spark, d), 2)


def changes_since(spark: SparkSession, d: str) -> DataFrame:
    """T2."""
    return M.changes_since(batches(spark, d), 3, 1 << 60, 1).select("seq", "what")


def due_deletes(spark: SparkSession, d: str) -> DataFrame:
    """T5: freed parts that no line of a status holds and all suppliers' cursors have passed."""
    freed = table(spark, d, "part").select("p_brand", F.concat(F.lit("f"), F.col("p_partkey")).alias("name"), (F.col("p_partkey") % 100).alias("seq"))
    holders = table(spark, d, "lineitem").where("l_quantity > 48").select(F.concat(F.lit("f"), F.col("l_partkey")).alias("name"))
    cursors = table(spark, d, "supplier").select(F.col("s_name").alias("client"), (F.col("s_suppkey") % 37 + 60).alias("seq"))
    return M.due_deletes(freed, holders, cursors)


def stale_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets are customers, reads their orders' priorities, the last run one without the newest files' change."""
    o = table(spark, d, "orders")
    targets = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("target"))
    reads = o.select(F.col("o_custkey").cast("string").alias("target"), F.concat(F.lit("p/"), F.col("o_orderkey") % 300).alias("path"))
    files = o.select(F.concat(F.lit("p/"), F.col("o_orderkey") % 300).alias("path"), (F.col("o_orderkey") % 300).cast("string").alias("hash")).distinct()
    old = files.where("path <> 'p/7'")
    last = M.stale_targets(targets, reads, old, spark.createDataFrame([], "target string, key string"))
    return M.stale_targets(targets, reads, files, last).select("target")


def reused_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a value copied from a previous run where type and size are the same, else computed."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    prev = p.where("p_partkey % 3 = 0").groupBy("p_type", "p_size").agg(F.min("p_partkey").alias("v")).select("p_type", "p_size", "v")
    return M.reuse_rows(p, prev, ["p_type", "p_size"], ["v"], lambda x: x.withColumn("v", -F.col("p_partkey"))).select("p_partkey", "v")


def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as input files; changed ones are checked, and held with their partners."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("hash"), "p_size", "p_retailprice", (F.col("p_partkey") + 1).cast("string").alias("partner"))
    accepted = p.where("p_size % 2 = 0").select("path", "hash")
    return M.gate(p, accepted, {"size": F.col("p_size") <= 40, "price": F.col("p_retailprice") > 905}, "partner")


def input_findings(spark: SparkSession, d: str) -> DataFrame:
    """P29."""
    s = table(spark, d, "summits")
    return J.findings(s, "id", {"height": F.col("ele").between(-500, 8900) & ~F.isnan("ele"), "position": ~((F.col("lon") == 0) & (F.col("lat") == 0))}).groupBy("rule").agg(F.countDistinct("id").alias("ids"), F.count("*").alias("n"))


def trains_default(spark: SparkSession, d: str) -> DataFrame:
    """Lookups with a default."""
    f = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.round("s_acctbal", 2).alias("f"))
    return J.with_default(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), f, "l_suppkey", {"f": 0.0}).groupBy("l_suppkey").agg(F.max("f").alias("f"), F.count("*").alias("n"))


def record_near(spark: SparkSession, d: str) -> DataFrame:
    """Records by id and point, the point a little off."""
    m = marks(spark, d)
    asks = m.select(F.col("id").alias("ask"), "id", (F.col("lon") + 0.5).alias("lon"), F.col("lat"))
    return J.by_id_near(asks, m.select("id", "lon", "lat", "kind"), 5).select("ask", "id", F.col("r_kind").alias("kind"))


def road_window(spark: SparkSession, d: str) -> DataFrame:
    """J5."""
    li = table(spark, d, "lineitem")
    ways = li.groupBy((F.col("l_orderkey") % 200).alias("road"), (F.col("l_partkey") % 1000).alias("off")).agg(F.min("l_partkey").alias("id"))
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seed"), (F.col("s_suppkey") % 200).alias("road"), (F.col("s_suppkey") * 37 % 1000).alias("at"))
    return J.along_road(seeds, ways, 40)


def boxes_meeting(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that meet."""
    def box(t, key, w):
        k = F.col(key)
        return table(spark, d, t).select(k.alias("id"), (k * 7919 % 36000).alias("west"), (k * 104729 % 17000).alias("south"), (k * 7919 % 36000 + w).alias("east"), (k * 104729 % 17000 + w).alias("north"))

    return J.boxes_meet(box("customer", "c_custkey", 300), box("supplier", "s_suppkey", 500), 1000.0)


def raster_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Bilinear values of a grid of parts at customers."""
    p = table(spark, d, "part").groupBy((F.col("p_partkey") % 40).alias("x"), (F.floor(F.col("p_partkey") / 40) % 40).alias("y")).agg(F.max("p_size").alias("v"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7 % 390) / 10.0).alias("px"), ((F.col("c_custkey") * 13 % 390) / 10.0).alias("py"))
    return J.raster_at(c, p, "v").select("id", F.round("value", 6).alias("value"))


def territory_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run-length rows."""
    s = table(spark, d, "supplier")
    r = s.select((F.col("s_suppkey") % 20).alias("row"), (F.col("s_suppkey") * 31 % 900).alias("first"), (F.col("s_suppkey") * 31 % 900 + 90).alias("last"), F.col("s_nationkey").alias("code"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 20).alias("row"), (F.col("c_custkey") * 17 % 1000).alias("col"))
    return J.run_at(c, r)


def overlay_picks(spark: SparkSession, d: str) -> DataFrame:
    """The overlays of all customers' boxes."""
    k = F.col("c_custkey")
    boxes = table(spark, d, "customer").select(k.alias("id"), (k * 79 % 360).alias("west"), (k * 104 % 170).alias("south"), (k * 79 % 360 + 5).alias("east"), (k * 104 % 170 + 5).alias("north"))
    s = F.col("s_suppkey")
    sets = table(spark, d, "supplier").select(F.col("s_name").alias("name"), s.alias("rank"), (s * 37 % 300).alias("w"), (s * 53 % 120).alias("s"), (s * 37 % 300 + 60).alias("e"), (s * 53 % 120 + 50).alias("n"))
    return J.overlay_picks(boxes, sets)


def available_pick(spark: SparkSession, d: str) -> DataFrame:
    """P24."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return J.available(p.select((k % 150).alias("set"), F.col("p_name").alias("name"), (F.col("p_size") % 6).alias("zoom"), (k % 4 == 0).alias("primary"), (k % 3).alias("availability"), (k % 7).alias("score"), (k % 2).alias("extent")).where("availability > 0"))


def downloaded(spark: SparkSession, d: str) -> DataFrame:
    """Points inside downloaded cells that the client does not have."""
    m = marks(spark, d).withColumn("x", F.floor(F.col("lon") / 10)).withColumn("y", F.floor(F.col("lat") / 10))
    cells = table(spark, d, "supplier").select(F.floor(((F.col("s_suppkey") * 7919 % 36000) / 100 - 180) / 10).alias("x"), F.floor(((F.col("s_suppkey") * 104729 % 17000) / 100 - 85) / 10).alias("y"))
    have = m.where("id % 5 = 0").select("id")
    return J.in_cells(m, cells).join(have, "id", "left_anti").select("id")


def tag_values(spark: SparkSession, d: str) -> DataFrame:
    """P19, P23 and the text functions, on texts made from parts."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.when(k % 4 == 0, F.concat(k % 90, F.lit(" m"))).when(k % 4 == 1, F.concat(k % 90, F.lit(" ft"))).when(k % 4 == 2, F.concat(k % 9, F.lit("' 6"))).otherwise(F.lit("high")).alias("h"), F.when(k % 2 == 0, F.concat(F.lit("built "), 1500 + k % 500)).otherwise(F.lit("C18")).alias("y"))
    return p.select("p_partkey", F.round(G.metres(F.col("h")), 4).alias("height"), G.year(F.col("y")).alias("year"), G.bits(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("bits"))


QUERIES = {
    f.__name__: f
    for f in (
        log_apply, log_stream, log_digests, map_diff, watch_marks, changes_since, due_deletes, stale_targets, reused_rows, gate_verdicts, input_findings, trains_default, record_near, road_window, boxes_meeting,
        raster_lookup, territory_runs, overlay_picks, available_pick, downloaded, tag_values,
    )
}

_O = """o as (select o_orderkey // 250 + 1 as seq, 'lm/' || (o_custkey % 7) || '/' || (o_custkey % 500) as key, o_orderkey, o_orderstatus, round(o_totalprice, 2) as p from orders),
ch as (select seq, key, case when arg_max(o_orderstatus, o_orderkey) <> 'P' then printf('%.2f', arg_max(p, o_orderkey)) end as value from o group by 1, 2)"""



def _state(n: int) -> str:
    return f"select * from (select key, arg_max(struct_pack(v := value), seq).v as value from ch where seq <= {n} group by key) where value is not null"


_MK = """m as (select c_custkey as id, c_mktsegment as kind, (c_custkey * 7919 % 36000) / 100.0 - 180 as lon, (c_custkey * 104729 % 17000) / 100.0 - 85 as lat from customer)"""
SQL = {
    "log_apply": f"with {_O} {_state(1 << 40)}",
    "log_stream": f"with {_O} {_state(1 << 40)}",
    "map_diff": f"with {_O}, a as ({_state(4)}), b as ({_state(1 << 40)}) select coalesce(a.key, b.key) as key, case when b.key is null then 'deleted' else 'set' end as what, b.value from a full join b on a.key = b.key where a.value is distinct from b.value",
    "watch_marks": f"with {_O} select split_part(key, '/', 1) || '/' || split_part(key, '/', 2) as prefix, max(seq) as seq from ch group by 1",
    "changes_since": f"with {_O} select distinct seq, 'batch' as what from ch where seq > 3",
    "due_deletes": "select 'f' || p_partkey as name, p_partkey % 100 as seq from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 48) and p_partkey % 100 <= (select min(s_suppkey % 37 + 60) from supplier)",
    "stale_targets": "select distinct cast(o_custkey as varchar) as target from orders where o_orderkey % 300 = 7",
    "reused_rows": "with v as (select p_type, p_size, min(p_partkey) as v from part where p_partkey % 3 = 0 group by 1, 2) select p_partkey, coalesce(v, -p_partkey) as v from part left join v using (p_type, p_size)",
    "gate_verdicts": """with n as (select p_partkey as k, case when p_size > 40 then 'size' when not p_retailprice > 905 then 'price' end as why from part where p_size % 2 <> 0)
select cast(n.k as varchar) as path, case when n.why is null and b.k is null then 'accepted' else 'held' end as verdict, coalesce(n.why, case when b.k is not null then 'partner' end) as why from n left join (select k from n where why is not null) b on b.k = n.k + 1""",
    "input_findings": """with f as (select id, 'height' as rule from summits where not coalesce(ele between -500 and 8900 and not isnan(ele), false) union all select id, 'position' from summits where lon = 0 and lat = 0
union all select id, 'duplicate' from summits group by id having count(*) > 1) select rule, count(distinct id) as ids, count(*) as n from f group by rule""",
    "trains_default": "select l_suppkey, coalesce(max(round(s_acctbal, 2)), 0) as f, count(*) as n from lineitem left join supplier on s_suppkey = l_suppkey and s_acctbal > 0 group by 1",
    "record_near": f"with {_MK} select id as ask, id, kind from m",
    "road_window": """with w as (select l_orderkey % 200 as road, l_partkey % 1000 as off, min(l_partkey) as id from lineitem group by 1, 2), j as (select s_suppkey as seed, w.*, abs(off - s_suppkey * 37 % 1000) <= 40 as ok from supplier join w on road = s_suppkey % 200)
select seed, road, id, off, cut from (select *, bool_or(not ok) over (partition by seed) as cut from j) where ok""",
    "boxes_meeting": """with a as (select c_custkey as id, c_custkey * 7919 % 36000 as w, c_custkey * 104729 % 17000 as s from customer), b as (select s_suppkey as id, s_suppkey * 7919 % 36000 as w, s_suppkey * 104729 % 17000 as s from supplier)
select a.id as a_id, b.id as b_id from a, b where a.w <= b.w + 500 and a.w + 300 >= b.w and a.s <= b.s + 500 and a.s + 300 >= b.s""",
    "raster_lookup": """with p as (select p_partkey % 40 as x, (p_partkey // 40) % 40 as y, max(p_size) as v from part group by 1, 2), c as (select c_custkey as id, (c_custkey * 7 % 390) / 10.0 - 0.5 as x, (c_custkey * 13 % 390) / 10.0 - 0.5 as y from customer),
k as (select id, cast(floor(x) as bigint) + i as cx, cast(floor(y) as bigint) + j as cy, (case when i = 1 then x - floor(x) else 1 - (x - floor(x)) end) * (case when j = 1 then y - floor(y) else 1 - (y - floor(y)) end) as w from c, (values (0), (1)) a(i), (values (0), (1)) b(j))
select id, round(sum(w * v) / sum(w), 6) as value from k join p on p.x = k.cx and p.y = k.cy where w > 0 group by id""",
    "territory_runs": "select c_custkey as id, min(s_nationkey) as code from customer join supplier on s_suppkey % 20 = c_custkey % 20 and c_custkey * 17 % 1000 between s_suppkey * 31 % 900 and s_suppkey * 31 % 900 + 90 group by 1",
    "overlay_picks": """with b as (select c_custkey as id, c_custkey * 79 % 360 as x, c_custkey * 104 % 170 as y from customer), s as (select s_name as name, s_suppkey as rank, s_suppkey * 37 % 300 as w, s_suppkey * 53 % 120 as s from supplier),
j as (select id, name, rank, min(case when w <= x and w + 60 >= x + 5 and s <= y and s + 50 >= y + 5 then rank end) over (partition by id) as f from b join s on w <= x + 5 and w + 60 >= x and s <= y + 5 and s + 50 >= y)
select id, name, rank from j where f is null or rank <= f""",
    "available_pick": """with p as (select p_partkey % 150 as set, p_name as name, p_size % 6 as zoom, p_partkey % 4 = 0 as pr, p_partkey % 3 as av, p_partkey % 7 as sc, p_partkey % 2 as ex from part where p_partkey % 3 > 0),
r as (select *, row_number() over (partition by set order by pr desc, zoom desc, av desc, sc desc, ex, name) as k from p) select set, name from r where k = 1""",
    "downloaded": f"with {_MK}, c as (select distinct floor(((s_suppkey * 7919 % 36000) / 100.0 - 180) / 10) as x, floor(((s_suppkey * 104729 % 17000) / 100.0 - 85) / 10) as y from supplier) select id from m where id % 5 <> 0 and exists (select 1 from c where c.x = floor(m.lon / 10) and c.y = floor(m.lat / 10))",
    "tag_values": """select p_partkey, round(case p_partkey % 4 when 0 then p_partkey % 90 when 1 then (p_partkey % 90) * 0.3048 when 2 then (p_partkey % 9) * 0.3048 + 6 * 0.0254 end, 4) as height, cast(case when p_partkey % 2 = 0 then 1500 + p_partkey % 500 else 1700 end as int) as year,
cast((case when p_partkey % 2 = 0 then 1 else 0 end) + (case when p_partkey % 3 = 0 then 2 else 0 end) + (case when p_partkey % 5 = 0 then 4 else 0 end) as int) as bits from part""",
}
SQL["log_digests"] = f"with {_O} " + " union all ".join(f"select {k} as seq, (select count(*) from ({_state(k)})) as n, true as same" for k in (1, 3, 5))
