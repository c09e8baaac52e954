"""Landmark operators: filters, histograms, top lists, thinning by zoom, nearest better neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import scoring as S
from wayline.functions import tiles
from wayline.operators.spatial import haversine_m, own_cell, touched_cells
from wayline.session import cut


def range_filter(c: Column, low: float | None, high: float | None, keep_unknown: bool) -> Column:
    """Whether a value lies in [low, high]; unknown ones pass when ``keep_unknown``."""
    ok = (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))
    return F.coalesce(ok, F.lit(keep_unknown))


def flag_filter(c: Column, bits: int, keep_unknown: bool) -> Column:
    """Whether a whole-number value has any of the bits."""
    has = reduce(lambda a, b: a | b, [(F.floor(c / (1 << i)) % 2) == 1 for i in range(32) if bits >> i & 1], F.lit(False))
    return F.coalesce(has, F.lit(keep_unknown))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, name: str = "bin") -> DataFrame:
    """(bin, n): values at or beyond the ends count in the first and last bin; null ones don't."""
    at = F.floor((value - low) / (high - low) * bins)
    return df.select(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def filter_histograms(df: DataFrame, filters: dict[str, tuple[Column, Column, float, float]], bins: int = 128) -> DataFrame:
    """(filter, bin, n): each filter's values over the rows that all the other filters keep, in one pass.
    ``filters``: name -> (value on its axis, test, low, high)."""
    tests = {k: F.coalesce(t, F.lit(False)) for k, (_, t, _, _) in filters.items()}
    entries = []
    for k, (v, _, low, high) in filters.items():
        others = reduce(lambda a, b: a & b, [t for n, t in tests.items() if n != k], F.lit(True))
        at = F.least(F.greatest(F.floor((v - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
        entries.append(F.when(others & v.isNotNull(), F.struct(F.lit(k).alias("filter"), at.alias("bin"))))
    return df.select(F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("x")).groupBy("x.filter", "x.bin").agg(F.count("*").alias("n")).select("filter", "bin", "n")


#: Buckets of value that running counts go over first, between the least and the greatest value.
BUCKETS = 4096


def _bucketed(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, value, n, before): how many rows have each known value and how many a smaller one.

    Counts run over at most BUCKETS buckets of value per group, one row each, and then within a bucket."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    low, high = n.agg(F.min("value"), F.max("value")).first()
    width = float(high - low) if low is not None and high > low else 1.0
    n = n.withColumn("__b", F.least(F.floor((F.col("value") - F.lit(low if low is not None else 0.0)) / width * BUCKETS), F.lit(BUCKETS - 1)))
    every = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = n.groupBy(*by, "__b").agg(F.sum("n").alias("__bn")).select(*by, "__b", F.coalesce(F.sum("__bn").over(every), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(*by, "__b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return n.join(sums, [*by, "__b"]).select(*by, "value", "n", (F.col("__before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("before"))


def score_at_ranks(df: DataFrame, score: str, ranks: list[int]) -> DataFrame:
    """(rank, score): the score at each rank from the top, ranks below 1 counting as 1 and ranks beyond the last giving the least score.

    Found by counting score values, not by sorting rows in one task."""
    x = _bucketed(df, score)
    total = df.agg(F.count(score).alias("n")).first().n
    asks = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(total - min(max(r, 1), total)).cast("long").alias("below")) for r in ranks])
    hit = F.filter(asks, lambda a: (a["below"] >= F.col("before")) & (a["below"] < F.col("before") + F.col("n")))
    return x.select(F.explode(hit).alias("a"), F.col("value").alias("score")).select("a.rank", "score")


def rank_from_below(df: DataFrame, by: list[str], value: str, tie: str, tie_width: int = 1 << 16) -> DataFrame:
    """Adds ``rank``: the row's place in its group from 0, the least value first, ties by ``tie`` (a whole number).

    Values are counted, and rows of one value are numbered by stretches of ``tie``, so neither a large group nor a frequent value is sorted in one task."""
    counts = _bucketed(df, value, by).select(*by, F.col("value").alias(value), "before")
    x = df.withColumn("__s", F.floor(F.col(tie) / tie_width))
    w = Window.partitionBy(*by, value).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    stretches = x.groupBy(*by, value, "__s").agg(F.count("*").alias("__n")).select(*by, value, "__s", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__stretch"))
    x = x.withColumn("__k", F.row_number().over(Window.partitionBy(*by, value, "__s").orderBy(tie)) - 1)
    x = x.join(stretches, [*by, value, "__s"]).join(counts, [*by, value])
    return x.withColumn("rank", F.col("before") + F.col("__stretch") + F.col("__k")).drop("before", "__stretch", "__k", "__s")


def top_per_kind(df: DataFrame, kind: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each kind with ``place`` from 1.  Each part of a kind keeps its own first k before they meet."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(32)))
    near = salted.withColumn("__p", F.row_number().over(Window.partitionBy(kind, "__salt").orderBy(*order))).where(F.col("__p") <= k).drop("__salt", "__p")
    return near.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("place") <= k)


def keep_zoom(df: DataFrame, kind: str, lon: str, lat: str, fame: str, isolation: str, rank: str, keep: int, max_zoom: int = 5, sizes: list[str] | None = None, keep_size: int = 64, min_zoom: str | None = None, named: str | None = None) -> DataFrame:
    """Adds ``kz``: the lowest zoom of 0..max_zoom whose tile keeps the row (max_zoom + 1: none).

    A tile keeps the first ``keep`` of a kind by score at each of five balances, the first ``keep_size`` by each size, and
    named rows whose ``min_zoom`` is at most the zoom less three.  Ties go to the smaller rank."""
    from wayline.constants import KEEP_BALANCES

    orders = [F.desc(S.landmark_score(F.col(fame), F.col(isolation), b)) for b in KEEP_BALANCES] + [F.desc_nulls_last(s) for s in sizes or []]

    def kept(x: DataFrame, part: list[str]) -> DataFrame:
        """The rows that are among the first of their part by any order."""
        keeps = F.lit(False)
        for i, o in enumerate(orders):
            x = x.withColumn(f"__r{i}", F.row_number().over(Window.partitionBy(*part).orderBy(o, rank)))
            size = i - len(KEEP_BALANCES)
            keeps = keeps | ((F.col(f"__r{i}") <= keep) if size < 0 else (F.col(f"__r{i}") <= keep_size) & F.col(sizes[size]).isNotNull())
        return x.where(keeps).drop(*[f"__r{i}" for i in range(len(orders))])

    # what a tile keeps, the tile below it keeps too, so only what the deepest tiles keep, a bounded number of rows, is looked at above; the first step is salted
    at_zoom = lambda x: x.withColumn("__t", tiles.tile_key_at(F.col(lon), F.col(lat), F.col("__z")))
    x = at_zoom(df.select(kind, rank, lon, lat, fame, isolation, *(sizes or [])).withColumn("__z", F.lit(max_zoom)))
    x = kept(x.withColumn("__salt", F.pmod(F.xxhash64(rank), F.lit(32))), [kind, "__t", "__salt"]).drop("__salt", "__t", "__z")
    x = kept(at_zoom(x.withColumn("__z", F.explode(F.sequence(F.lit(0), F.lit(max_zoom))))), [kind, "__t"])
    found = x.select(kind, rank, "__z")
    if min_zoom and named:
        at = F.greatest(F.ceil(F.col(min_zoom)) + 3, F.lit(0)).cast("int")
        found = found.unionByName(df.where(F.col(named) & (at <= max_zoom)).select(kind, rank, at.alias("__z")))
    per = found.groupBy(kind, rank).agg(F.min("__z").alias("kz"))
    return df.join(per, [kind, rank], "left").withColumn("kz", F.coalesce("kz", F.lit(max_zoom + 1)))


def speck_cells(df: DataFrame, lon: str, lat: str, zoom: int, deeper: int = 10, by: list[str] | None = None) -> DataFrame:
    """(tile, cell, n): points per Morton cell of each tile."""
    x, y = tiles.tile_x(F.col(lon), zoom + deeper), tiles.tile_y(F.col(lat), zoom + deeper)
    side = 1 << deeper
    cell = tiles.morton(x % side, y % side, deeper)
    tile = tiles.tile_key(F.lit(zoom), F.floor(x / side), F.floor(y / side))
    return df.select(tile.alias("tile"), cell.alias("cell"), *(by or [])).groupBy("tile", "cell", *(by or [])).agg(F.count("*").alias("n"))


def nearest_better(df: DataFrame, group: list[str], id_col: str, lon: str, lat: str, score: str, unknown_km: float = 20_000.0, first_km: float = 1.0, growth: float = 8.0) -> DataFrame:
    """(group, id, km): distance to the nearest row of the group with a higher score, of equal scores one with a smaller id.

    Rows at one position are settled first: all but the best of them are at distance 0 from a better one.  Then rings of growing radius: each
    level joins the rows still open with the best of the cells they touch, and only where that is better with the cell's rows; beyond a
    quarter of the globe every cell neighbours every other and the few rows left (no better one within thousands of kilometres: the
    globe has room for a few hundred per group) are compared with the better rows of their group.  Rows without a better one get ``unknown_km``.
    """
    d = df.select(*group, F.col(id_col).alias("id"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), F.col(score).cast("double").alias("score")).where("id is not null and lon is not null and lat is not null and score is not null").distinct()
    rank = F.struct(-F.col("score"), F.col("id"))
    best = d.groupBy(*group, "lon", "lat").agg(F.min_by("id", rank).alias("best"), F.count("*").alias("here"))
    d = cut(d.join(best, [*group, "lon", "lat"]))
    done = d.where("id <> best").select(*group, "id", F.lit(0.0).alias("m"))
    d = d.where("id = best").select(*group, "id", "lon", "lat", "score")
    open_ = d
    radius = first_km * 1000.0
    b = d.select(*group, F.col("id").alias("id2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("score").alias("score2"))
    better = (F.col("score2") > F.col("score")) | ((F.col("score2") == F.col("score")) & (F.col("id2") < F.col("id")))
    m = haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    while True:
        whole = radius >= 2_500_000.0
        if whole:
            # what is still open has no better row within the last radius: in each group, few rows
            pairs = open_.join(b, group).where(better)
        else:
            cells = b.withColumn("cell", own_cell(F.col("lon2"), F.col("lat2"), radius))
            top = cells.groupBy(*group, "cell").agg(F.max("score2").alias("score2"), F.min_by("id2", F.struct(-F.col("score2"), "id2")).alias("id2"))
            a = open_.withColumn("cell", F.explode(F.array_distinct(touched_cells(F.col("lon"), F.col("lat"), radius))))
            a = a.join(top, [*group, "cell"]).where(better).drop("score2", "id2")
            pairs = a.join(cells, [*group, "cell"]).where(better)
        hit = pairs.withColumn("m", m).where(F.lit(True) if whole else F.col("m") <= radius).groupBy(*group, "id").agg(F.min("m").alias("m"))
        hit = cut(hit)
        done = done.unionByName(hit)
        if whole:
            break
        open_ = cut(open_.join(hit.select(*group, "id"), [*group, "id"], "left_anti"))
        radius *= growth
        if not open_.limit(1).count():
            break
    every = df.select(*group, F.col(id_col).alias("id"), F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.col(score).alias("score")).where("id is not null and lon is not null and lat is not null and score is not null").select(*group, "id").distinct()
    return every.join(done.groupBy(*group, "id").agg(F.min("m").alias("m")), [*group, "id"], "left").select(*group, "id", F.least(F.coalesce(F.col("m") / 1000.0, F.lit(unknown_km)), F.lit(unknown_km)).alias("km"))


def exists_within(a: DataFrame, b: DataFrame, radius_m: float) -> DataFrame:
    """The ids of ``a`` (id, pos) with any point of ``b`` at most ``radius_m`` away."""
    x = a.where("id is not null and pos is not null").select("id", "pos").distinct()
    y = b.where("pos is not null").select(F.col("pos").alias("pos2")).distinct()
    x = x.withColumn("cell", F.explode(F.array_distinct(touched_cells(F.col("pos.lon"), F.col("pos.lat"), radius_m))))
    y = y.withColumn("cell", own_cell(F.col("pos2.lon"), F.col("pos2.lat"), radius_m))
    near = haversine_m(F.col("pos.lon"), F.col("pos.lat"), F.col("pos2.lon"), F.col("pos2.lat")) <= radius_m
    return x.join(y, (x["cell"] == y["cell"]) & near, "left_semi").select("id").distinct()


def nearest_k(a: DataFrame, b: DataFrame, radius_m: float, k: int) -> DataFrame:
    """(a_id, b_id, metres, place): the ``k`` nearest points of b within the radius, ties by id."""
    from wayline.operators.spatial import within_distance

    w = Window.partitionBy("a_id").orderBy("metres", "b_id")
    return within_distance(a, b, radius_m).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def label_zoom(km: Column, size_zoom: Column | None = None) -> Column:
    """The zoom from which a label shows by its isolation: one zoom per halving below 2,000 km, from 2 to 14."""
    z = F.greatest(F.lit(2.0), F.least(F.lit(14.0), F.round(2 + F.log2(2000.0 / F.greatest(km, F.lit(0.05))), 2)))
    return F.least(z, size_zoom) if size_zoom is not None else z


def rank_by_counts(df: DataFrame, value: str) -> DataFrame:
    """Adds ``share``: the share of rows with a known value at or below (0 where unknown), by counts of values, so that no task sorts all rows."""
    x = _bucketed(df, value)
    total = x.agg(F.sum("n")).first()[0] or 1
    return df.join(x.select(F.col("value").alias(value), ((F.col("before") + F.col("n")) / total).alias("share")), value, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def held_back(df: DataFrame, group: list[str], name: str, id_col: str, lon: str, lat: str, score: str, km: float) -> DataFrame:
    """The ids of rows within ``km`` of a better row of the same kind and folded name."""
    folded = df.where(F.col(name).isNotNull()).withColumn("__name", F.lower(F.trim(name)))
    return nearest_better(folded, [*group, "__name"], id_col, lon, lat, score).where(F.col("km") <= km).select("id")


