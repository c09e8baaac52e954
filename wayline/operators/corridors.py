"""What lies along roads and tracks: frontages, parallel tracks, merged stops, thinned pieces, outlines of sites."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.registers import connected


def _box_distance(x: Column, y: Column) -> Column:
    dx = F.greatest(F.col("x0") - x, x - F.col("x1"), F.lit(0.0))
    dy = F.greatest(F.col("y0") - y, y - F.col("y1"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def frontage(samples: DataFrame, boxes: DataFrame, along: float = 50.0, step: float = 5.0, near: float = 30.0, far: float = 80.0, least_m2: float = 15.0, widest: float = 1500.0) -> DataFrame:
    """(id, share): how far buildings line a road at its samples.

    samples: id, x, y (metres), heading (radians from east), hidden boolean (tunnels and rails: share 0).  boxes: x0, y0, x1, y1.  Points every ``step`` within
    ``along`` of the sample; on each side the nearest box counts 1 up to ``near`` metres, fading to 0 at ``far``; the mean over points and
    sides.  Boxes under ``least_m2`` or wider than ``widest`` are left out.  A box is on the side of its centre.

    Samples of one place and heading are measured once, and boxes are met in the cells whose points can reach them only."""
    n = int(along // step)
    cell = lambda v: F.floor(v / far)
    b = boxes.where(((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least_m2) & (F.col("x1") - F.col("x0") <= widest) & (F.col("y1") - F.col("y0") <= widest)).select("x0", "y0", "x1", "y1").distinct()
    # a point's cell is among those of the box grown by ``far``
    b = b.withColumn("cx", F.explode(F.sequence(cell(F.col("x0") - far), cell(F.col("x1") + far)))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0") - far), cell(F.col("y1") + far))))
    seen = samples.where(~F.coalesce("hidden", F.lit(False)))
    s = seen.select("x", "y", "heading").distinct().select("x", "y", "heading", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("k"))
    s = s.withColumn("px", F.col("x") + F.cos("heading") * F.col("k") * step).withColumn("py", F.col("y") + F.sin("heading") * F.col("k") * step)
    j = s.withColumn("cx", cell(F.col("px"))).withColumn("cy", cell(F.col("py"))).join(b, ["cx", "cy"])
    left = F.cos("heading") * ((F.col("y0") + F.col("y1")) / 2 - F.col("py")) - F.sin("heading") * ((F.col("x0") + F.col("x1")) / 2 - F.col("px")) > 0
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (far - _box_distance(F.col("px"), F.col("py"))) / (far - near)))
    best = j.groupBy("x", "y", "heading", "k", left.alias("side")).agg(F.max(w).alias("w"))
    got = best.groupBy("x", "y", "heading").agg((F.sum("w") / (2 * (2 * n + 1))).alias("share"))
    share = seen.select("id", "x", "y", "heading").join(got, ["x", "y", "heading"]).select("id", "share")
    return samples.select("id").distinct().join(share, "id", "left").select("id", F.coalesce("share", F.lit(0.0)).alias("share"))


def parallel_tracks(points: DataFrame, within: float = 40.0, degrees: float = 20.0) -> DataFrame:
    """(track, other): tracks with points close to each other, of one service and about one direction (either way).
    points: track, x, y, heading (radians), service.

    Places are paired, not points: tracks that share a place, direction and service are one set there, and each pair of sets is taken apart once."""
    cell = lambda v: F.floor(F.col(v) / within)
    p = points.groupBy("x", "y", "heading", "service").agg(F.array_sort(F.collect_set("track")).alias("tracks"))
    a = p.select("tracks", "x", "y", "heading", "service", F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    b = p.select(F.col("tracks").alias("others"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("heading").alias("oh"), "service", cell("x").alias("cx"), cell("y").alias("cy"))
    turn = F.pmod(F.abs(F.col("heading") - F.col("oh")), F.lit(math.pi))
    near = (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= within) & (F.least(turn, math.pi - turn) <= math.radians(degrees))
    sets = a.join(b, ["cx", "cy", "service"]).where(near).select("tracks", "others").distinct()
    each = sets.select(F.explode("tracks").alias("track"), "others").select("track", F.explode("others").alias("other"))
    return each.where(F.col("track") != F.col("other")).distinct()


def _near_parts(places: DataFrame, key: str, reach: Column) -> DataFrame:
    """(key, x, y, part): distinct places (x, y) of a key by connected parts of those within ``reach`` (by key) of each other, paired by grid cells; one alone has no part."""
    p = places.select(key, "x", "y").distinct().withColumn("__r", reach)
    cell = lambda v: F.floor(F.col(v) / F.col("__r"))
    name = lambda k, x, y: F.concat_ws("/", k, x, y)
    a = p.select(key, "x", "y", "__r", F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")).select(key, "x", "y", "__r", "c.cx", "c.cy")
    b = p.select(key, F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = a.join(b, [key, "cx", "cy"]).where((F.struct("x", "y") < F.struct("ox", "oy")) & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= F.col("__r")))
    root = connected(near.select(name(key, "x", "y").alias("a"), name(key, "ox", "oy").alias("b")))
    return places.join(root.select(F.col("id").alias("__at"), F.col("root").alias("part")), name(key, "x", "y") == F.col("__at"), "left").drop("__at")


def merge_stops(stops: DataFrame, named_m: float = 800.0, unnamed_m: float = 100.0) -> DataFrame:
    """(id, stop): stops of one folded name within ``named_m`` (unnamed: ``unnamed_m``) of a merged stop join it, in order of id.

    The order matters within a name's connected parts of stops that near to each other only, as none joins a stop of another part; each part is worked off
    in one group and must fit a task (stops of one name side by side).  stops: id, name, x, y (metres)."""
    folded = F.lower(F.trim(F.coalesce("name", F.lit(""))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        reach = named_m if pdf["key"].iloc[0] else unnamed_m
        x, y, ids = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["id"].to_numpy()
        heads = np.empty(len(pdf), np.int64)
        n = 0
        out = np.empty(len(pdf), np.int64)
        for i in range(len(pdf)):
            at = heads[:n]
            d = np.hypot(x[at] - x[i], y[at] - y[i])
            k = int(d.argmin()) if n else -1
            if k < 0 or d[k] > reach:
                heads[n] = k = i
                n += 1
                out[i] = ids[i]
            else:
                out[i] = ids[at[k]]
        return pd.DataFrame({"id": ids, "stop": out})

    s = stops.select(F.col("id").cast("long").alias("id"), folded.alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("id is not null and x is not null and y is not null")
    s = _near_parts(s, "key", F.when(F.col("key") == "", unnamed_m).otherwise(named_m))
    alone = s.where("part is null")
    # places without another near them: their rows share one position
    same = alone.groupBy("key", "x", "y").agg(F.min("id").alias("stop"))
    return alone.join(same, ["key", "x", "y"]).select("id", "stop").unionByName(s.where("part is not null").groupBy("part").applyInPandas(run, "id long, stop long"))


def thin_pieces(pieces: DataFrame, tile: str, order: str, cells: str) -> DataFrame:
    """The pieces of each tile that, in draw order, reach a cell none kept before reaches; ``cells`` is an array.  Pieces of one tile and place in the order stay together.

    What a dropped piece reaches, kept ones before it reach, so a piece is kept if and only if it is the first of all to reach some cell: a grouped minimum, no walk."""
    x = pieces.where(F.col(cells).isNotNull())
    first = x.select(tile, F.col(order).alias("__o"), F.explode(cells).alias("__cell")).groupBy(tile, "__cell").agg(F.min("__o").alias(order))
    return x.join(first.select(tile, order).distinct(), [tile, order], "left_semi")


def site_outlines(sites: DataFrame, parts: DataFrame, relations: DataFrame, members: DataFrame, most: float = 3.0) -> DataFrame:
    """(site, way): ways of the relations that name a site or one of its parts, where the relation's area is at most ``most`` times the inscribed one.
    sites: site, area; parts: part, site; relations: relation, ref, area; members: relation, way."""
    refs = sites.select("site", F.col("site").alias("ref")).unionByName(parts.select("site", F.col("part").alias("ref")))
    ok = relations.withColumnRenamed("area", "r_area").join(refs, "ref").join(sites.select("site", F.col("area").alias("s_area")), "site").where((F.col("s_area") <= 0) | (F.col("r_area") <= most * F.col("s_area")))
    return ok.select("site", "relation").distinct().join(members, "relation").select("site", "way").distinct()
