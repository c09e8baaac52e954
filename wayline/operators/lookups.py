"""Joins of map queries: defaults, neighbours in tiles, offset windows, boxes, rasters, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import tiles
from wayline.session import broadcast_checked


def with_default(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object], small: int = 100_000) -> DataFrame:
    """Left join with defaults for what is missing on the right; the right side is broadcast while it has at most ``small`` rows."""
    return left.join(broadcast_checked(right.select(on, *defaults), small), on, "left").select(*left.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def by_id_near(asks: DataFrame, records: DataFrame, zoom: int = 6) -> DataFrame:
    """Records (id, lon, lat, ...) of asks (ask, id, lon, lat) in the ask's tile, else in a tile next to it; of several the own tile's, then the smallest tile's."""
    r = records.select("id", *[F.col(c).alias(f"r_{c}") for c in records.columns if c != "id"], tiles.tile_key_at(F.col("lon"), F.col("lat"), F.lit(zoom)).alias("tile"))
    x, y = tiles.tile_x(F.col("lon"), zoom), tiles.tile_y(F.col("lat"), zoom)
    a = asks.withColumn("__own", tiles.tile_key(F.lit(zoom), x, y)).withColumn("__n", F.explode(tiles.neighbour_tiles(x, y, zoom))).withColumn("tile", tiles.tile_key(F.lit(zoom), F.col("__n.x"), F.col("__n.y")))
    cols = [c for c in r.columns if c not in ("id",)]
    hit = a.join(r, ["id", "tile"]).groupBy("ask").agg(F.min_by(F.struct("id", *cols), F.struct((F.col("tile") != F.col("__own")).cast("int"), "tile")).alias("b"))
    return hit.select("ask", "b.*")


def along_road(seeds: DataFrame, ways: DataFrame, reach: float) -> DataFrame:
    """Ways (road, off, id, len) of each seed's road (seed, road, at) whose start lies within ``reach`` of the seed, with ``cut``: whether any of the road was left out."""
    j = seeds.join(ways, "road").withColumn("__in", F.abs(F.col("off") - F.col("at")) <= reach)
    x = j.withColumn("cut", F.max((~F.col("__in")).cast("int")).over(Window.partitionBy("seed")) == 1)
    return x.where("__in").select("seed", "road", "id", "off", "cut")


def boxes_meet(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a_id, b_id): boxes (id, west, south, east, north) that meet, edges included; joined by the cells that both cover."""
    def spread(d: DataFrame, p: str) -> DataFrame:
        r = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
        d = d.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("west", "south", "east", "north")])
        return d.withColumn("cx", F.explode(r(f"{p}_west", f"{p}_east"))).withColumn("cy", F.explode(r(f"{p}_south", f"{p}_north")))

    meet = "a_west <= b_east and a_east >= b_west and a_south <= b_north and a_north >= b_south"
    return spread(a, "a").join(spread(b, "b"), ["cx", "cy"]).where(meet).select("a_id", "b_id").distinct()


def raster_at(points: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """(id, value): bilinear value of cells (x, y) at points (id, px, py) in cells, centres at .5; where a neighbour is missing the nearest
    corner's weight goes to the others."""
    x, y = F.col("px") - 0.5, F.col("py") - 0.5
    fx, fy = x - F.floor(x), y - F.floor(y)
    corner = lambda i, j: F.struct((F.floor(x) + i).alias("x"), (F.floor(y) + j).alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    p = points.select("id", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("c")).select("id", "c.*").where("w > 0")
    g = p.join(cells.select("x", "y", F.col(value).cast("double").alias("v")), ["x", "y"]).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("t"), F.sum("w").alias("w"))
    return g.select("id", (F.col("t") / F.col("w")).alias("value"))


def run_at(points: DataFrame, runs: DataFrame, chunk: int = 64) -> DataFrame:
    """(id, code): the run (row, first, last, code) that holds each point (id, row, col); runs are cut into chunks so that the join is an equality."""
    r = runs.withColumn("__c", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor(F.col("last") / chunk))))
    p = points.withColumn("__c", F.floor(F.col("col") / chunk))
    return p.join(r, ["row", "__c"]).where("col between first and last").groupBy("id").agg(F.min("code").alias("code"))


def first_by_rank(left: DataFrame, pieces: DataFrame, on: str, order: list[Column], values: list[str]) -> DataFrame:
    """For each left row the values of the first matching piece in the order (ranked as a group's minimum; no sort)."""
    best = pieces.groupBy(on).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("b"))
    return left.join(best, on, "left").select(*left.columns, "b.*")


def overlay_picks(boxes: DataFrame, datasets: DataFrame, cell: float = 20.0) -> DataFrame:
    """(id, name, rank): for each box (id, west, south, east, north) the datasets (name, rank, w, s, e, n) that meet it in order of rank, up to
    the first that contains it; joined by the cells that both cover.

    Boxes of one extent have the same datasets, so extents are met, each with the best rank of its datasets; the rows come last.  Ids are unique."""
    def extents(d: DataFrame, sides: list[str], *best: Column) -> DataFrame:
        g = d.groupBy(*[F.col(c).alias(k) for c, k in zip(sides, ("west", "south", "east", "north"))]).agg(F.count("*"), *best)
        return g.withColumn("id", F.struct("west", "south", "east", "north"))

    a, d = extents(boxes, ["west", "south", "east", "north"]), extents(datasets, ["w", "s", "e", "n"], F.min("rank").alias("best"))
    met = boxes_meet(a, d, cell).select(*[F.col(f"a_id.{c}").alias(c) for c in ("west", "south", "east", "north")], *[F.col(f"b_id.{c}").alias(k) for c, k in zip(("west", "south", "east", "north"), "wsen")])
    met = met.join(d.select(*[F.col(c).alias(k) for c, k in zip(("west", "south", "east", "north"), "wsen")], "best"), list("wsen"))
    holds = (F.col("w") <= F.col("west")) & (F.col("e") >= F.col("east")) & (F.col("s") <= F.col("south")) & (F.col("n") >= F.col("north"))
    upto = F.col("__f").isNull() | (F.col("best") <= F.col("__f"))
    met = met.withColumn("__f", F.min(F.when(holds, F.col("best"))).over(Window.partitionBy("west", "south", "east", "north"))).where(upto)
    picks = met.join(datasets, list("wsen")).where(F.col("__f").isNull() | (F.col("rank") <= F.col("__f"))).select("west", "south", "east", "north", "name", "rank")
    return boxes.join(picks, ["west", "south", "east", "north"]).select("id", "name", "rank")


def available(pieces: DataFrame) -> DataFrame:
    """(set, name): the piece shown for each set of pieces: the finest primary, then the best availability, score and extent class, then the smallest name.
    pieces: set, name, zoom, primary boolean, availability, score, extent."""
    order = F.struct((~F.col("primary")).cast("int"), -F.col("zoom"), -F.col("availability"), -F.col("score"), "extent", "name")
    return pieces.groupBy("set").agg(F.min_by("name", order).alias("name"))


def in_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points whose cell (x, y) is among the downloaded ones."""
    return points.join(cells.select("x", "y").distinct(), ["x", "y"], "left_semi")


def findings(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule): the rules that rows break (a null outcome is a breach), and 'duplicate' for ids that occur twice or more."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    one = df.select(F.col(id_col).alias("id"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))
    twice = df.groupBy(F.col(id_col).alias("id")).count().where("count > 1").select("id", F.lit("duplicate").alias("rule"))
    return one.unionByName(twice)
