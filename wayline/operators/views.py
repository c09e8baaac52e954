"""The map's queries with their own parameters: drives, rides, landmarks in view, parks and places by name.

Each is one declared plan over tables; the lists that come back are short, their details are joined to them by what was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline import constants as C
from wayline.functions import scoring as S
from wayline.operators import landmarks as L
from wayline.operators import sequences as Q
from wayline.operators.registers import view_holds
from wayline.session import cut

Ring = list[tuple[float, float]]
EVERY = (1 << 31) - 1


def ring_of(view: Ring | tuple[float, float, float, float]) -> Ring:
    """A view's outline: itself, or the corners of a box (west, south, east, north)."""
    if len(view) == 4 and not isinstance(view[0], (tuple, list)):
        w, s, e, n = view
        return [(w, s), (e, s), (e, n), (w, n)]
    return list(view)


def _checked(weights: list[float], n: int, length_km: float, limit: int) -> tuple[float, int]:
    if len(weights) != n:
        raise ValueError(f"{n} weights are needed, not {len(weights)}")
    return min(max(length_km, 0.5), 100.0) * 1000.0, max(0, min(limit, 100))


def _stretches(samples: DataFrame, parts: list[Column], score: Column, ring: Ring, length: float) -> DataFrame:
    """Samples in runs (a gap of more than GAP_M or a sample left out ends one) with their parts, score and whether they are in view."""
    x = samples.withColumn("parts", F.array(*parts)).withColumn("score", score).withColumn("seen", view_holds(ring, F.col("lon"), F.col("lat")))
    return Q.islands(x, "road", "off", C.GAP_M, 64 * length)


def _found(runs: DataFrame, length: float) -> DataFrame:
    best = Q.best_window(runs, ["road", "run"], "off", "score", length, C.GAP_M, tie="way", in_view="seen")
    return cut(best.select("road", "run", "off0", "off1", "n", "mean"))


def _of_roads(samples: DataFrame, top: DataFrame) -> DataFrame:
    """The samples of the roads of a short list, at most 100 of them: what a list shows is worked out for these only."""
    return samples.join(F.broadcast(top.select("road").distinct()), "road", "left_semi")


def _described(top: DataFrame, runs: DataFrame, n_parts: int, extra: list[str]) -> DataFrame:
    """Each stretch's mean parts, geometry, first and middle sample.  ``top`` is a short list of stretches of at most 100 km."""
    x = runs.drop("run").join(F.broadcast(top.drop("run", "n")), "road").where((F.col("off") >= F.col("off0")) & (F.col("off") <= F.col("off1")))
    at = F.struct("off", "way", "lon", "lat", *extra)
    g = x.groupBy("road", F.col("off0"), F.col("off1"), "mean").agg(F.array(*[F.avg(F.get("parts", F.lit(i))) for i in range(n_parts)]).alias("parts"), F.array_sort(F.collect_list(at)).alias("s"))
    mid = F.get("s", F.floor((F.size("s") - 1) / 2).cast("int"))
    return g.select("road", "off0", "off1", "mean", "parts", F.get("s", F.lit(0)).alias("first"), mid.alias("mid"), F.transform("s", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("geom"))


def drives(samples: DataFrame, ways: DataFrame, view, weights: list[float], length_km: float = 5.0, limit: int = 20, classes: int = EVERY, surface: int = 3, toll: int = 3, unnamed: int = 0, least: float | None = None, most: float | None = None) -> DataFrame:
    """The best stretches of roads in view: (place, score 0..100, length_m, road, off0, off1, way, at, mid_way, name, ref, class, parts, geom, total).

    samples: road, off (m), way, lon, lat, ch (channels); ways: way, class, flags, name, ref, road_m.  Of each run of samples that the filters keep, the
    stretch of at least ``length_km`` with the best mean score whose middle is in view.  total: how many runs have one.  Wrong parameters are a ValueError."""
    length, limit = _checked(weights, len(C.DRIVE_COMPONENTS), length_km, limit)
    keep = S.drive_filter(F.col("class"), F.col("flags"), classes, surface, toll, unnamed) & S.length_filter(F.col("road_m"), least, most)
    kept = ways.where(keep).select("way")
    parts = S.drive_components(F.col("ch"))
    run = lambda x: _stretches(x.join(kept, "way", "left_semi"), parts, S.weighted_score(parts, weights), ring_of(view), length)
    best = _found(run(samples), length)
    top = cut(best.orderBy(F.desc("mean"), "road", "off0").limit(limit))
    runs = run(_of_roads(samples, top))
    info = ways.select(F.col("way").alias("mid_way"), "name", "ref", "class")
    d = _described(top, runs, len(parts), []).withColumn("mid_way", F.col("mid.way")).join(info, "mid_way", "left").withColumn("total", F.lit(best.count()))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), "road", "off0"))
    return d.select(place.alias("place"), (F.col("mean") * 100).alias("score"), (F.col("off1") - F.col("off0")).alias("length_m"), "road", "off0", "off1", F.col("first.way").alias("way"), F.struct("first.lon", "first.lat").alias("at"), "mid_way", "name", "ref", "class", "parts", "geom", "total")


def rail_identity(name: Column, route: Column) -> Column:
    """A rail line's name without its route's direction: before a colon; "A => B" and its return are "A – B"; without a name the first service's."""
    raw = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.split_part(F.coalesce(route, F.lit("")), F.lit(" · "), F.lit(1)))
    n = F.trim(F.split_part(raw, F.lit(":"), F.lit(1)))
    ends = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(n, "=>"), lambda e: F.trim(e)), lambda e: e != "")))
    return F.when(n.contains("=>"), F.concat_ws(" – ", ends)).otherwise(n)


def rides(samples: DataFrame, ways: DataFrame, trains: DataFrame, view, weights: list[float], length_km: float = 5.0, limit: int = 30, groups: int = 0xFF) -> DataFrame:
    """The best stretch of each rail line in view: (place, score 0..100, length_m, road, off0, off1, way, line, rel, services, colour, trains, parts, geom, total).

    samples: road, off, way, lon, lat, ch, eye (m over ground), flags; ways: way, class, rail (service groups), name, route, colour, rel; trains: way, trains (a day).  A line is known by
    rail_identity of its run's first way; trains, rel, services and colour are the middle way's.  total: how many lines have a stretch."""
    length, limit = _checked(weights, len(C.RIDE_COMPONENTS), length_km, limit)
    w = ways.where(S.rail_group_filter(F.col("rail"), F.col("class") - 10, groups) & ((F.col("rail") != 0) | (F.col("class") >= 10)))
    w = w.select("way", rail_identity(F.col("name"), F.col("route")).alias("line")).join(trains.select("way", "trains"), "way", "left")
    parts = S.ride_components(F.col("ch"), F.col("eye"), F.col("flags"), F.col("grade"))
    day = F.coalesce(F.col("trains"), F.lit(0.0))
    shown = [*parts[:-1], F.coalesce(S.frequency(day), F.lit(0.0))]
    run = lambda x: Q.islands(x.join(w, "way"), "road", "off", C.GAP_M, 64 * length)

    def scored(x: DataFrame) -> DataFrame:
        x = Q.neighbour_grade(run(x), ["road", "run"], "off", "eye", "way", 64 * length)
        return x.withColumn("parts", F.array(*shown)).withColumn("score", S.ride_score(parts, day, weights)).withColumn("seen", view_holds(ring_of(view), F.col("lon"), F.col("lat")))

    best = Q.best_window(scored(samples), ["road", "run"], "off", "score", length, C.GAP_M, tie="way", in_view="seen")
    first = run(samples.select("road", "off", "way")).groupBy("road", "run").agg(F.min_by("line", F.struct("off", "way")).alias("line"))
    order = F.struct(-F.col("mean"), "road", "off0")
    lines = cut(best.join(first, ["road", "run"]).groupBy("line").agg(F.min_by(F.struct("road", "run", "off0", "off1", "n", "mean"), order).alias("b")).select("line", "b.*"))
    top = cut(lines.orderBy(F.desc("mean"), "road", "off0").limit(limit))
    d = _described(top.drop("line"), scored(_of_roads(samples, top)).drop("line"), len(parts), ["trains"]).join(F.broadcast(top.select("road", "off0", "line")), ["road", "off0"])
    info = ways.select(F.col("way").alias("mid_way"), "rel", F.col("route").alias("services"), "colour")
    d = d.withColumn("mid_way", F.col("mid.way")).join(info, "mid_way", "left").withColumn("total", F.lit(lines.count()))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), "road", "off0"))
    return d.select(
        place.alias("place"), (F.col("mean") * 100).alias("score"), (F.col("off1") - F.col("off0")).alias("length_m"), "road", "off0", "off1", F.col("first.way").alias("way"), "line", "rel", "services", "colour",
        F.coalesce("mid.trains", F.lit(0.0)).alias("trains"), "parts", "geom", "total",
    )


def window_geometry(points: DataFrame, windows: DataFrame) -> DataFrame:
    """(road, off0, off1, geom): of the real points (road, off, lon, lat) those from the one nearest a window's start to the one nearest its end, in order.

    windows: road, off0, off1 and lo, hi: the stretch of the road that its bins cover.  Of equally near points the first counts."""
    x = points.join(windows, "road").where((F.col("off") >= F.col("lo")) & (F.col("off") <= F.col("hi")))
    g = x.groupBy("road", "off0", "off1").agg(F.min(F.struct(F.abs(F.col("off") - F.col("off0")).alias("d"), F.col("off").alias("at"))).alias("a"), F.min(F.struct(F.abs(F.col("off") - F.col("off1")).alias("d"), F.col("off").alias("at"))).alias("b"), F.array_sort(F.collect_list(F.struct("off", "lon", "lat"))).alias("s"))
    low, high = F.least("a.at", "b.at"), F.greatest("a.at", "b.at")
    return g.select("road", "off0", "off1", F.transform(F.filter("s", lambda p: (p["off"] >= low) & (p["off"] <= high)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("geom"))


EXTRA_MOST = 5000


def marks_view(
    marks: DataFrame, view, kinds: list[str], balance: float = 0.25, top: int = 50, ranks: tuple[int, int] = (10, 1000), off: dict[str, list[str]] | None = None, filters: dict[str, dict[str, tuple[float | None, float | None]]] | None = None,
    keep_unknown: tuple[str, ...] = (), histograms: dict[str, dict[str, tuple[Column, float, float]]] | None = None, zoom: int | None = None, low: float | None = None,
) -> dict[str, DataFrame]:
    """Landmarks in view, as several tables: 'candidates', 'histogram' (512 bins of the score), 'at_ranks', 'by_kind' (count and best-known named), 'top', 'top_by_kind',
    'filters' (per kind and filter the values that the other filters keep) and, with ``zoom``, 'extra': what the tiles up to that zoom lack and scores above ``low`` (else
    the lower of the scores at the ranks, spread to at least 0.02), EXTRA_MOST in the list's order.

    marks: kind, id, lon, lat, fa (fame), ia (isolation, km), rank, kz, tier, flags, name and the filters' columns.  ``kinds`` are in the order of the request, ``off`` the tiers switched off."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    x = marks.where(F.col("kind").isin(kinds) & ~S.bit(F.col("flags"), C.MARK_COMPONENT) & view_holds(ring_of(view), F.col("lon"), F.col("lat")))
    for kind, tiers in (off or {}).items():
        x = x.where((F.col("kind") != kind) | ~F.coalesce(F.col("tier").isin(tiers), F.lit(False)))
    every = x
    for kind, tests in (filters or {}).items():
        for column, (lo, hi) in tests.items():
            x = x.where((F.col("kind") != kind) | L.range_filter(F.col(column), lo, hi, kind in keep_unknown))
    x = cut(x.withColumn("score", S.landmark_score(F.col("fa"), F.col("ia"), balance)).withColumn("qi", place[F.col("kind")]))
    order = [F.desc("score"), F.asc("qi"), F.asc("rank")]
    named = S.bit(F.col("flags"), C.MARK_NAMED)
    out = {
        "candidates": x, "histogram": L.histogram(x, F.col("score"), 0.0, 1.0, 512), "at_ranks": L.score_at_ranks(x.select("score"), "score", list(ranks)),
        "by_kind": x.groupBy("kind").agg(F.count("*").alias("n"), F.min_by(F.when(named, F.col("id")), F.when(named, F.struct(-F.col("fa"), "rank"))).alias("best")),
        "top": x.orderBy(*order).limit(top), "top_by_kind": L.top_per_kind(x, "kind", order, top),
    }
    if histograms:
        parts = None
        for kind, values in histograms.items():
            tests = (filters or {}).get(kind, {})
            f = {k: (v, L.range_filter(F.col(k), *tests[k], kind in keep_unknown) if k in tests else F.lit(True), lo, hi) for k, (v, lo, hi) in values.items()}
            h = L.filter_histograms(every.where(F.col("kind") == kind), f).withColumn("kind", F.lit(kind))
            parts = h if parts is None else parts.unionByName(h)
        out["filters"] = parts
    if zoom is not None:
        if low is None:
            a, b = out["at_ranks"].agg(F.min("score"), F.max("score")).first()
            low = 0.0 if a is None else a if b - a >= 0.02 else max((a + b) / 2 - 0.01, 0.0)
        out["extra"] = x.where((F.col("kz") > zoom) & (F.col("score") > low)).orderBy(*order).limit(EXTRA_MOST)
    return out


def _local_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Short distances in metres on a plane that touches the sphere between the points."""
    return F.hypot(F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), F.radians(lat2 - lat1)) * C.EARTH_M


def park_at(parks: DataFrame, asks: DataFrame, pad: float = 0.002, most_m: float = 5000.0) -> DataFrame:
    """(ask, park): the park of the asked name whose box holds the point (the smallest of nested ones), else the nearest of that name closer than ``most_m``.

    parks: park, name, west, south, east, north, area; asks: ask, name, lon, lat.  Names count without case and outer blanks; asks without such a park have no row."""
    fold = lambda c: F.lower(F.trim(c))
    p = parks.select("park", fold(F.col("name")).alias("key"), "west", "south", "east", "north", "area")
    x = asks.select("ask", fold(F.col("name")).alias("key"), "lon", "lat").join(p, "key")
    inside = F.col("lon").between(F.col("west") - pad, F.col("east") + pad) & F.col("lat").between(F.col("south") - pad, F.col("north") + pad)
    near = _local_m(F.col("lon"), F.col("lat"), S.clamp_between(F.col("lon"), F.col("west"), F.col("east")), S.clamp_between(F.col("lat"), F.col("south"), F.col("north")))
    x = x.withColumn("inside", inside).withColumn("m", near).where(F.col("inside") | (F.col("m") < most_m))
    order = F.struct((~F.col("inside")).cast("int"), F.when(F.col("inside"), F.col("area")).otherwise(F.col("m")), "park")
    return x.groupBy("ask").agg(F.min_by("park", order).alias("park"))


def place_words(name: Column) -> Column:
    """Words of a name for a search: lower case, split at what is no letter or digit."""
    return F.filter(F.array_distinct(F.split(F.lower(name), r"[^\p{L}\p{N}]+")), lambda w: w != "")


def place_index(places: DataFrame) -> DataFrame:
    """(key, place, name, rank, lon, lat, word): one row per word of a place's name; key: the word's first two letters, by which an index is stored and asked."""
    x = places.select("place", "name", "rank", "lon", "lat", F.explode(place_words(F.col("name"))).alias("word"))
    return x.withColumn("key", F.substring("word", 1, 2))


def find_places(index: DataFrame, typed: str, lon: float, lat: float, limit: int = 10) -> DataFrame:
    """(place, name, rank, m): places with every typed word as the beginning of one of their own, the best rank first, among like ones the nearest.  Two letters at least."""
    words = list(dict.fromkeys("".join(c.lower() if c.isalnum() else " " for c in typed).split()))
    if sum(map(len, words)) < 2:
        return index.select("place", "name", "rank", F.lit(0.0).alias("m")).limit(0)
    hit = F.lit(False)
    for w in words:
        hit = hit | (F.col("word").startswith(w) & ((F.col("key") == w[:2]) if len(w) > 1 else F.lit(True)))
    which = F.array(*[F.when(F.col("word").startswith(w), F.lit(i)) for i, w in enumerate(words)])
    x = index.where(hit).select("place", "name", "rank", "lon", "lat", F.explode(F.filter(which, lambda v: v.isNotNull())).alias("i"))
    x = x.groupBy("place", "name", "rank", "lon", "lat").agg(F.countDistinct("i").alias("n")).where(F.col("n") == len(words))
    return x.withColumn("m", _local_m(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))).orderBy(F.desc("rank"), "m", "place").limit(limit).select("place", "name", "rank", "m")
