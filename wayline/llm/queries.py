"""The pN_ queries of the problems on texts and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.linkage import fold, link
from wayline.llm.lookalike import LOOK_ALIKE, lookalike_classes, lookalike_pairs, skeleton_column
from wayline.llm.mixing import mix, shares
from wayline.llm.packing import fill_report, pack
from wayline.llm.spans import shared_runs, shared_shares
from wayline.llm.tokens import source_name
from wayline.operators.spatial import position, region_of
from wayline.session import broadcast_checked, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "federal"), "id", "name")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """One form of each name."""
    names = table(spark, d, "federal").select("id", "name").distinct()
    return names.withColumn("form", skeleton_column(names["name"], composed=True))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each id's name with the class of names that look the same."""
    return lookalike_classes(table(spark, d, "federal"), "id", "name").select("id", F.col("text").alias("name"), "class", "rows")


def _folded(c):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {v: fold(v) or None for v in s.unique() if v is not None}
        return s.map(known.get)

    return run(c)


def _federal(spark: SparkSession, d: str) -> DataFrame:
    """Designated places as linkage wants them; rows of one id are the same."""
    codes = table(spark, d, "provs").select(F.upper(F.trim("prov")).alias("code"), F.lower(F.trim("name")).alias("said"))
    codes = codes.unionByName(codes.select("code", F.lower("code").alias("said"))).distinct()
    marks = table(spark, d, "designations").select("designation", "des").distinct()
    f = table(spark, d, "federal").dropDuplicates(["id"]).where("id is not null and name is not null")
    f = f.withColumn("said", F.lower(F.trim("prov"))).join(broadcast_checked(codes, 10_000), "said", "left").join(broadcast_checked(marks, 10_000), "designation", "left")
    text = "array<string>"
    return f.select(
        "id", F.concat(F.array("name"), F.coalesce("others", F.array().cast(text))).alias("names"),
        F.when(F.col("code").isNotNull(), F.array("code")).otherwise(F.array().cast(text)).alias("regions"), F.array().cast(text).alias("near"),
        F.filter(F.array(_folded(F.col("area"))), lambda x: x.isNotNull()).alias("places"),
        F.expr("try_cast(nullif(regexp_extract(dated, '([0-9]{4})', 1), '') as int)").alias("year"),
        F.filter(F.array("des"), lambda x: x.isNotNull()).alias("marks"),
    )


#: Degrees that an item's position may lie over a border, looked for in eight directions.
OVER_BORDER = (0.1, 0.3)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Heritage items, one row per item, with the provinces that hold its position and those close to it."""
    num = r"(-?[0-9]+(?:[.][0-9]+)?)"
    part = lambda i: F.regexp_extract("coord", rf"^Point[(]{num} {num}[)]$", i).try_cast("double")
    w = table(spark, d, "wditems").where("item is not null")
    at = w.select("item", position(part(1), part(2)).alias("p")).where("p is not null").distinct()
    steps = [(0.0, 0.0)] + [(r * x, r * y) for r in OVER_BORDER for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]
    moved = F.array(*[F.struct(F.lit(i).alias("step"), F.struct((F.col("p.lon") + x).alias("lon"), (F.col("p.lat") + y).alias("lat")).alias("pos")) for i, (x, y) in enumerate(steps)])
    pts = at.select("item", F.explode(moved).alias("m")).select(F.struct("item", F.col("m.step").alias("step")).alias("id"), "m.pos")
    held = region_of(pts, table(spark, d, "provs").select(F.upper(F.trim("prov")).alias("region"), "ring")).select("id.item", "id.step", "region")
    held = held.groupBy("item").agg(F.collect_set(F.when(F.col("step") == 0, F.col("region"))).alias("regions"), F.collect_set(F.when(F.col("step") > 0, F.col("region"))).alias("near"))
    one = w.groupBy("item").agg(
        F.array_union(F.collect_set("name_en"), F.collect_set("name_fr")).alias("names"), F.max("place").alias("place"),
        F.min(F.expr("try_cast(nullif(regexp_extract(since, '([0-9]{4})', 1), '') as int)")).alias("year"), F.collect_set("des").alias("marks"),
    )
    none = F.array().cast("array<string>")
    return one.join(held, "item", "left").select(
        F.col("item").alias("id"), "names", F.coalesce("regions", none).alias("regions"), F.coalesce("near", none).alias("near"),
        F.filter(F.array(_folded(F.col("place"))), lambda x: x.isNotNull()).alias("places"), "year", "marks",
    )


#: Designations whose names are left out of the names of places.
MOST_PHRASES = 10_000


def _linked(spark: SparkSession, d: str) -> DataFrame:
    # the table of designations is small by contract and is checked; its names are left out of the names of places
    found = table(spark, d, "designations").where("designation is not null").select("designation").distinct().limit(MOST_PHRASES + 1).collect()
    if len(found) > MOST_PHRASES:
        raise ValueError(f"at most {MOST_PHRASES} designations")
    return link(_federal(spark, d), _items(spark, d), tuple(sorted(r.designation for r in found)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select(F.col("a").alias("federal_id"), F.col("b").alias("item"))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """The matches with their confidence."""
    return _linked(spark, d).select(F.col("a").alias("federal_id"), F.col("b").alias("item"), F.round("score", 4).alias("score"), "confidence")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """What each container holds, for every capacity."""
    return pack(table(spark, d, "documents"), table(spark, d, "containers"), "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_packed(spark, d))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per container: texts placed, bins beyond the capacity, texts whose stretches of tokens leave a hole or overlap, and those split though they fit."""
    x = p7_packed(spark, d)
    over = x.groupBy("container", "bin").agg((F.sum("n_tokens") > F.max("capacity")).alias("over")).groupBy("container").agg(F.count(F.when(F.col("over"), 1)).alias("overfull"))
    per = x.groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max("token_to").alias("to"), F.min("token_from").alias("first"), F.count("*").alias("parts"), F.max("capacity").alias("capacity"))
    bad = per.groupBy("container").agg(F.count("*").alias("texts"), F.count(F.when((F.col("n") != F.col("to")) | (F.col("first") != 0), 1)).alias("torn"), F.count(F.when((F.col("parts") > 1) & (F.col("n") <= F.col("capacity")), 1)).alias("split"))
    return bad.join(over, "container").select("container", "texts", "overfull", "torn", "split")


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The mixture's records in order."""
    return mix(table(spark, d, "documents"), table(spark, d, "mixture"), "doc_id", "text", "source").withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p8_mixed(spark, d), table(spark, d, "mixture"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the mixture: whether it is there, no record of it more often than allowed, no record twice in a pass, and its share of those there within a hundredth."""
    x, m = p8_mixed(spark, d), table(spark, d, "mixture")
    most = m.select(source_name(F.col("source")).alias("source"), "max_repeats").where("source is not null").groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    times = x.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("pass").alias("passes")).groupBy("source").agg(F.max("n").alias("n"), F.max(F.col("n") - F.col("passes")).alias("twice"))
    s = shares(x, m).select("source", "share_of_present", "share")
    return s.join(most, "source").join(times, "source", "left").select("source", F.col("n").isNotNull().alias("there"), (F.coalesce("n", F.lit(0)) <= F.col("max_repeats")).alias("within"), (F.coalesce("twice", F.lit(0)) == 0).alias("once"), (F.abs(F.col("share") - F.col("share_of_present")) <= 0.01).alias("near"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_runs(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    x = shared_shares(table(spark, d, "documents"), "doc_id", "text")
    return x.select(F.col("doc").alias("doc_id"), "chars", "shared", "share")


QUERIES = {f.__name__: f for f in (p4_found, p4_forms, p4_classes, p6_found, p6_links, p7_packed, p7_fill, p7_kept, p8_mixed, p8_shares, p8_kept, p9_found, p9_shares)}
_SHARED = """with t as (select doc_id, text, length(text) as n from documents where length(text) >= 100),
w as (select doc_id, unnest(generate_series(0, n - 100)) as a, text from t), h as (select doc_id, a, md5(substring(text, a + 1, 100)) as h from w),
g as (select h from h group by h having min(doc_id) <> max(doc_id)), s as (select doc_id, a from h where h in (select h from g)),
b as (select *, lag(a) over (partition by doc_id order by a) as p from s), i as (select doc_id, a, sum(case when p is null or a > p + 100 then 1 else 0 end) over (partition by doc_id order by a rows unbounded preceding) as g from b),
f as (select doc_id, min(a) as start_pos, max(a) + 100 as end_pos from i group by doc_id, g)"""
# the skeleton by translation of single characters and composition: wide forms and blanks by rule, letters by the operator's own table
_PAIRS = [(c, v) for c, v in LOOK_ALIKE.items()] + [(chr(0xFF01 + i), chr(0x21 + i)) for i in range(94)] + [(c, " ") for c in "\t\n\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_FROM, _TO = ("".join(x).replace("'", "''") for x in zip(*_PAIRS))
_BLANK = "".join(chr(c) for c in [0xAD, 0x34F, 0x61C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF])
_LIGATURES = (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\u2026", "..."))
_FORM = f"translate(translate(nfc_normalize(name), '{_BLANK}', ''), '{_FROM}', '{_TO}')"
for _a, _b in _LIGATURES:
    _FORM = f"replace({_FORM}, '{_a}', '{_b}')"
_FORM = f"trim(regexp_replace(nfc_normalize({_FORM}), ' +', ' ', 'g'))"
_LOOKS = f"i as (select distinct id, name, {_FORM} as form from federal where id is not null and name is not null), k as (select * from i where form <> '')"
SQL: dict[str, str] = {
    "p4_forms": f"select distinct id, name, {_FORM} as form from federal",
    "p4_classes": f"with {_LOOKS}, c as (select form, min(name) as class from k group by form), n as (select name, count(*) as rows from i group by name) select k.id, k.name, c.class, n.rows from k join c using (form) join n on n.name = k.name",
    "p4_found": f"with {_LOOKS} select distinct a.id as id_a, b.id as id_b from k a join k b on a.form = b.form and a.name <> b.name and a.id < b.id",
    "p7_kept": "select container, (select count(*) from documents where doc_id is not null and length(text) > 0) as texts, 0 as overfull, 0 as torn, 0 as split from containers where capacity > 0",
    "p8_kept": r"""with m as (select distinct regexp_replace(lower(trim(source)), '[\s_]+', '-', 'g') as source from mixture where trim(source) <> ''),
d as (select distinct regexp_replace(lower(trim(source)), '[\s_]+', '-', 'g') as source from documents where length(text) > 0)
select source, source in (select source from d where source is not null) as there, true as within, true as once, true as near from m""",
    "p9_found": f"{_SHARED} select doc_id, start_pos, end_pos from f",
    "p9_shares": f"""{_SHARED}, k as (select doc_id, sum(end_pos - start_pos) as shared from f group by doc_id)
select d.doc_id, coalesce(length(text), 0) as chars, coalesce(shared, 0) as shared, case when coalesce(length(text), 0) > 0 then round(coalesce(shared, 0) / length(text), 6) else 0 end as share from documents d left join k on k.doc_id = d.doc_id""",
}
