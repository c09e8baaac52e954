"""Operators over registers of places: views, words of names, merging, groups, facts, translations, ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import cut


def view_holds(ring: list[tuple[float, float]], lon: Column, lat: Column) -> Column:
    """Whether points lie in a view's outline, even-odd, on the stereographic plane centred on the outline.

    Outlines over the date line or round a pole need no special case there.  The far side of the globe is never in view; an outline of
    fewer than three corners holds nothing."""
    if len(ring) < 3:
        return F.lit(False)
    vec = [(math.cos(math.radians(b)) * math.cos(math.radians(a)), math.cos(math.radians(b)) * math.sin(math.radians(a)), math.sin(math.radians(b))) for a, b in ring]
    c = [sum(v[i] for v in vec) for i in range(3)]
    size = math.sqrt(sum(x * x for x in c)) or 1.0
    c = [x / size for x in c]
    lon0, lat0 = math.atan2(c[1], c[0]), math.asin(max(-1.0, min(1.0, c[2])))

    def flat(a: float, b: float) -> tuple[float, float]:
        a, b = math.radians(a) - lon0, math.radians(b)
        k = 2 / max(1e-9, 1 + math.sin(lat0) * math.sin(b) + math.cos(lat0) * math.cos(b) * math.cos(a))
        return k * math.cos(b) * math.sin(a), k * (math.cos(lat0) * math.sin(b) - math.sin(lat0) * math.cos(b) * math.cos(a))

    pts = [flat(a, b) for a, b in ring]
    a, b = F.radians(lon) - lon0, F.radians(lat)
    near = 1 + math.sin(lat0) * F.sin(b) + math.cos(lat0) * F.cos(b) * F.cos(a)
    k = 2 / F.greatest(near, F.lit(1e-9))
    x, y = k * F.cos(b) * F.sin(a), k * (math.cos(lat0) * F.sin(b) - math.sin(lat0) * F.cos(b) * F.cos(a))
    sides = [(*p, *q) for p, q in zip(pts, pts[1:] + pts[:1]) if p[1] != q[1]]
    if len(sides) <= 32:
        # plain arithmetic stays in generated code, and without branches the point's plane coordinates are worked out once for all sides
        hits = [((F.lit(y0) > y) != (F.lit(y1) > y)).cast("int") * (x < (x1 - x0) / (y1 - y0) * (y - y0) + x0).cast("int") for x0, y0, x1, y1 in sides]
        return (near > 1.0) & (sum(hits[1:], hits[0] if hits else F.lit(0)) % 2 == 1)
    edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), e)]) for e in sides])

    def inside(p: Column) -> Column:
        crosses = lambda e: ((e["y0"] > p["y"]) != (e["y1"] > p["y"])) & (p["x"] < (e["x1"] - e["x0"]) * (p["y"] - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])
        return F.size(F.filter(edges, crosses)) % 2 == 1

    # the point goes through a lambda so that its trigonometry is worked out once, not once per edge
    return (near > 1.0) & F.get(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), inside), F.lit(0))


def name_words(c: str) -> Column:
    """Distinct words of three letters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.col(c)), "[^a-zà-ÿ]+"), lambda w: F.length(w) >= 3)))


def shared_words(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """(a, b, share): rows of one cell that share at least ``share`` of the shorter name's words.  a: a, wa, cell; b: b, wb, cell."""
    common = F.size(F.array_intersect("wa", "wb"))
    least = F.least(F.size("wa"), F.size("wb"))
    x = a.where("size(wa) > 0").join(b.where("size(wb) > 0"), "cell").where(common >= share * least)
    return x.select("a", "b", F.round(common / least, 4).alias("share")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable from each node of ``edges`` (a, b).

    Alternating large-star and small-star steps: every round is two grouped minima, the number of rounds grows with the logarithm of
    the size.  Self-edges keep a node; null ends are dropped."""
    e = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    e = cut(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), F.col("m")))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        e = cut(small)
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return nodes.join(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def greedy_merge(pairs: DataFrame, register_order: list[str]) -> DataFrame:
    """(drop, keep): of matched sites (a, a_register, b, b_register) the one of the later register goes, each site at most once, in order.

    The order matters only within a connected group, so groups are worked off apart."""
    groups = connected(pairs.select("a", "b"))
    order = {r: i for i, r in enumerate(register_order)}

    def run(pdf):
        import pandas as pd

        gone, out = set(), []
        pdf = pdf.assign(ra=pdf["a_register"].map(order).fillna(len(order)), rb=pdf["b_register"].map(order).fillna(len(order)))
        for r in pdf.sort_values(["ra", "rb", "a", "b"]).itertuples():
            if r.a in gone or r.b in gone or r.a == r.b:
                continue
            keep, drop = (r.a, r.b) if (r.ra, r.a) <= (r.rb, r.b) else (r.b, r.a)
            gone.add(drop)
            out.append((drop, keep))
        return pd.DataFrame(out, columns=["drop", "keep"])

    p = pairs.select(F.col("a").cast("string").alias("a"), "a_register", F.col("b").cast("string").alias("b"), "b_register")
    return p.join(groups.select(F.col("id").alias("a"), "root"), "a").groupBy("root").applyInPandas(run, "drop string, keep string")


def first_translation(asks: DataFrame, lines: DataFrame, id_col: str) -> DataFrame:
    """(id, name, lang, text): for each ask (id, name, langs array) the line of the first language that has one.
    lines: name, lang, text, file, line; of several the one of the latest file, then line, counts."""
    latest = lines.groupBy("name", "lang").agg(F.max_by("text", F.struct("file", "line")).alias("text"))
    x = asks.select(id_col, "name", F.posexplode("langs").alias("pos", "lang")).join(latest, ["name", "lang"])
    return x.groupBy(id_col, "name").agg(F.min_by(F.struct("lang", "text"), "pos").alias("x")).select(id_col, "name", "x.*")


def reduce_facts(facts: DataFrame, item: str, labels: list[str] = (), earliest: list[str] = (), largest: list[str] = (), least: list[str] = ()) -> DataFrame:
    """One row per item of facts (item, k, v): distinct labels sorted and joined by ' | ', earliest dates, largest and least numbers."""
    of = lambda k: F.when(F.col("k") == k, F.col("v"))
    aggs = [F.concat_ws(" | ", F.array_sort(F.collect_set(of(k)))).alias(k) for k in labels]
    aggs += [F.min(of(k)).alias(f"{k}_earliest") for k in earliest]
    aggs += [F.max(of(k).try_cast("double")).alias(f"{k}_largest") for k in largest] + [F.min(of(k).try_cast("double")).alias(f"{k}_least") for k in least]
    return facts.groupBy(item).agg(*aggs)


def assign_ids(df: DataFrame, wanted: str, order: str) -> DataFrame:
    """Adds ``id``: the wanted id for its first row by ``order``, then with ~1, ~2, ..."""
    k = F.row_number().over(Window.partitionBy(wanted).orderBy(order)) - 1
    return df.withColumn("__k", k).select(*[c for c in df.columns if c != wanted], F.concat(F.col(wanted), F.when(F.col("__k") > 0, F.concat(F.lit("~"), F.col("__k"))).otherwise("")).alias("id"))


def repeated_labels(df: DataFrame, kind: str, name: str, lon: str, lat: str, importance: str, km: float = 30.0) -> DataFrame:
    """Rows whose label stays: in order of importance, none within ``km`` of a label of its kind and name that stays.
    Greedy within one kind and name, worked off apart."""

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values([importance, lon, lat], ascending=[False, True, True], kind="stable")
        x = np.radians(pdf[lon].to_numpy(float)) * np.cos(np.radians(pdf[lat].to_numpy(float)))
        y = np.radians(pdf[lat].to_numpy(float))
        keep: list[int] = []
        for i in range(len(pdf)):
            if not keep or (np.hypot(x[keep] - x[i], y[keep] - y[i]) * 6371.0088 > km).all():
                keep.append(i)
        return pdf.iloc[keep]

    return df.where(F.col(name).isNotNull()).groupBy(kind, name).applyInPandas(run, df.schema)
