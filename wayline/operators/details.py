"""What map and list views show of single things: way details, colours, draw orders, dots of registers, runs of cells, tiles' parts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import tiles
from wayline.functions.scoring import bit, clamp

# Bits of a way's flags, and of a drawn line's style beside its class.
WAY_FLAGS = {"link": 1, "bridge": 2, "tunnel": 4, "unpaved": 8, "oneway": 16, "toll": 32, "scenic": 64, "covered": 128}
STYLE_UNPAVED, STYLE_BRIDGE, STYLE_TUNNEL, STYLE_LINK = 16, 32, 64, 128
CLASS_FERRY = 9
RAIL_NAMES = ("tram", "metro", "commuter", "intercity", "heritage")


def way_detail(ways: DataFrame, vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per way: its flags as booleans, rail groups, colour, lowest and highest point, and the shares of its vertices' height sources.

    ways: way, flags, rail (bits), colour, length_m, road, road_m; vertices: way, height_dm, source (0: none); labels: source, label."""
    v = vertices.groupBy("way", "source").agg(F.count("*").alias("n"), F.min("height_dm").alias("low"), F.max("height_dm").alias("high"))
    v = v.join(labels, "source", "left")
    total = v.groupBy("way").agg(F.sum("n").alias("vertices"), (F.min("low") / 10).alias("elev_min"), (F.max("high") / 10).alias("elev_max"), F.array_sort(F.collect_list(F.when(F.col("source") > 0, F.struct("source", "label", "n")))).alias("s"))
    sources = F.transform("s", lambda x: F.struct(x["label"].alias("label"), (x["n"] / F.col("vertices")).alias("share")))
    rail = F.filter(F.array(*[F.when(bit(F.col("rail"), 1 << i), F.lit(n)) for i, n in enumerate(RAIL_NAMES)]), lambda x: x.isNotNull())
    return ways.join(total, "way").select(
        "way", *[bit(F.col("flags"), m).alias(k) for k, m in WAY_FLAGS.items()], rail.alias("rail"), F.when(F.col("colour") != 0, F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("colour").bitwiseAND(F.lit(0xFFFFFF)))), 6, "0"))).otherwise("").alias("colour"),
        "length_m", "elev_min", "elev_max", sources.alias("sources"), "road", "road_m",
    )


def colour_metric(mode: str, elev: Column, grade: Column, ch: Column, score: Column | None = None) -> Column:
    """A vertex's value in the display unit of a colour mode; ``ch``: its channels in the order of CHANNELS."""
    c = lambda i: F.get(ch, F.lit(i)).cast("double")
    share = lambda i: c(i) / 2.55
    values = {
        "elev": elev, "relief": elev, "grade": grade, "score": score, "view": c(0) / 255, "water": c(1) / 255, "vista": c(8) / 17, "drama": c(2) * 3, "ridge": (c(3) - 128) * 2, "curvy": c(4) * 4,
        "openness": 100 - share(5), "trees": c(11) / 8, "forest": share(10), "fields": share(9), "built": share(6), "bldg": F.coalesce(c(12), F.lit(0.0)) / 2.55, "map": F.lit(0.0),
    }
    if mode not in values or values[mode] is None:
        raise ValueError(f"no colour mode {mode}")
    return values[mode].cast("double")


def style_of(cls: Column, flags: Column) -> Column:
    """A line's style: class in the low four bits, then unpaved, bridge, tunnel and link."""
    out = cls.bitwiseAND(F.lit(15)).cast("int")
    for name, b in (("unpaved", STYLE_UNPAVED), ("bridge", STYLE_BRIDGE), ("tunnel", STYLE_TUNNEL), ("link", STYLE_LINK)):
        out = out + F.when(bit(flags, WAY_FLAGS[name]), b).otherwise(0)
    return out


def draw_key(style: Column) -> Column:
    """Draw order of a style: ferries and tunnels, then ways, then bridges, each from minor to major class."""
    c = style.bitwiseAND(F.lit(15))
    group = F.when((c == CLASS_FERRY) | bit(style, STYLE_TUNNEL), 0).when(bit(style, STYLE_BRIDGE), 2).otherwise(1)
    return (group * 16 + c).cast("int")


def draw_order(pieces: DataFrame, tile: str, style: str, way: str, lon: str, lat: str, part: str) -> DataFrame:
    """Adds ``place`` (from 1) of each piece in its tile: draw order, way, where the piece starts, its place along the way.  A tile holds what is drawn in it."""
    return pieces.withColumn("place", F.row_number().over(Window.partitionBy(tile).orderBy(draw_key(F.col(style)), way, lon, lat, part)))


def _linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def _encoded(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def luminance(colour: Column) -> Column:
    """Linear light of a colour (struct r, g, b of 0..255)."""
    return 0.2126 * _linear(colour["r"] / 255.0) + 0.7152 * _linear(colour["g"] / 255.0) + 0.0722 * _linear(colour["b"] / 255.0)


def water_alpha(share: Column, water: Column, land: Column) -> Column:
    """Alpha (0..255) at which water over land, blended in stored values, is as light as ``share`` of the water's and the rest of the land's light."""
    yw, yl = luminance(water), luminance(land)
    ew, el = _encoded(yw), _encoded(yl)
    mixed = (_encoded(share * yw + (1.0 - share) * yl) - el) / (ew - el)
    return F.when(F.abs(ew - el) < 1e-3, share * 255.0).otherwise(clamp(mixed, 0.0, 1.0) * 255.0)


def rail_todo(relations: DataFrame, members: DataFrame, lengths: DataFrame) -> DataFrame:
    """(osm, name, ref, operator, km, served_km, passenger): lines, each the relations of one network and ref, else of one network and the same two ends, else one alone.

    relations: id, tags map; members: id, way; lengths: way, metres, served.  The first relation (smallest id) names the line; a way counts once.
    Lines without a known length are left out."""
    tag = lambda k: F.coalesce(F.col("tags")[k], F.lit(""))
    who = F.lower(F.when(tag("network") == "", tag("operator")).otherwise(tag("network")))
    ends = F.concat_ws("\u001f", F.array_sort(F.array(F.lower(tag("from")), F.lower(tag("to")))))
    key = F.when(tag("ref") != "", F.concat_ws("\u001e", F.lit("ref"), who, F.lower(tag("ref")))).when((tag("from") != "") & (tag("to") != ""), F.concat_ws("\u001e", F.lit("ends"), who, ends)).otherwise(F.concat_ws("\u001e", F.lit("r"), F.col("id").cast("string")))
    r = relations.withColumn("line", key)
    first = lambda k: F.min_by(F.col("tags")[k], F.when(F.col("tags")[k].isNotNull(), F.col("id")))
    heads = r.groupBy("line").agg(
        F.min("id").alias("osm"), *[F.coalesce(first(k), F.lit("")).alias(k) for k in ("name", "ref", "operator", "network")],
        F.min(((tag("passenger") != "no") & (tag("service") != "freight")).cast("int")).alias("passenger"),
    )
    km = r.select("id", "line").join(members, "id").select("line", "way").distinct().join(lengths, "way").groupBy("line").agg((F.sum("metres") / 1000).alias("km"), (F.sum(F.when(F.col("served"), F.col("metres")).otherwise(0.0)) / 1000).alias("served_km"))
    x = heads.join(km, "line").where("km > 0")
    return x.select("osm", "name", "ref", F.when(F.col("operator") == "", F.col("network")).otherwise(F.col("operator")).alias("operator"), F.round("km", 1).alias("km"), F.round("served_km", 1).alias("served_km"), (F.col("passenger") == 1).alias("passenger"))


def todo_order(rows: DataFrame, priority: str, kind: str, osm: str) -> DataFrame:
    """Rows sorted by falling priority, then kind and object."""
    return rows.orderBy(F.desc_nulls_last(priority), kind, osm)


def merged_sites(parts: DataFrame, sites: DataFrame) -> DataFrame:
    """(id, site, is_dot, lon, lat, name, components): sites in several components as one dot at the site's centre that takes its record from the part at
    the site's lead position (the first by id), and their components as parts; other features stay as they are.

    parts: id, site (null: none), lon, lat, name, component; sites: site, lon, lat (its dot), lead_lon, lead_lat, n."""
    s = sites.select("site", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"), "lead_lon", "lead_lat", "n")
    x = parts.join(s, "site", "left")
    several = F.col("s_lon").isNotNull()
    at_lead = (F.round("lon", 6) == F.col("lead_lon")) & (F.round("lat", 6) == F.col("lead_lat"))
    dots = x.where(several & at_lead).groupBy("site").agg(F.min_by(F.struct("id", "name", "s_lon", "s_lat", "n"), "id").alias("d"))
    dots = dots.select("d.id", "site", F.lit(True).alias("is_dot"), F.col("d.s_lon").alias("lon"), F.col("d.s_lat").alias("lat"), "d.name", F.col("d.n").alias("components"))
    rest = x.select("id", "site", F.when(several, False).alias("is_dot"), "lon", "lat", F.when(several, F.coalesce(F.when(F.col("component") != "", F.col("component")), F.col("name"))).otherwise(F.col("name")).alias("name"), F.lit(None).cast("int").alias("components"))
    return dots.unionByName(rest)


def register_summary(entries: DataFrame, register: str, lon: str, lat: str) -> DataFrame:
    """(register, n, placed, west, south, east, north): entries of each register, those with a position and their bounds."""
    ok = F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)
    at = lambda c: F.when(ok, F.col(c))
    return entries.groupBy(register).agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("placed"), F.min(at(lon)).alias("west"), F.min(at(lat)).alias("south"), F.max(at(lon)).alias("east"), F.max(at(lat)).alias("north"))


#: Kilometres of a degree, roughly, of longitude at the equator and of latitude (fixed values).
KM_LON, KM_LAT = 111.32, 110.57


def km_in_box(segments: DataFrame, group: str, box: tuple[float, float, float, float]) -> DataFrame:
    """(group, km): length of segments (x0, y0, x1, y1 in degrees) inside a box (west, south, east, north), by group."""
    west, south, east, north = box
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t0, t1 = F.lit(0.0), F.lit(1.0)
    ok = F.lit(True)
    for d, p, lo, hi in ((dx, F.col("x0"), west, east), (dy, F.col("y0"), south, north)):
        a, b = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        t0, t1 = F.greatest(t0, F.least(a, b)), F.least(t1, F.greatest(a, b))
        ok = ok & ((d != 0) | ((p >= lo) & (p <= hi)))
    mid = F.radians((F.col("y0") + F.col("y1")) / 2)
    km = F.greatest(t1 - t0, F.lit(0.0)) * F.hypot(dx * KM_LON * F.cos(mid), dy * KM_LAT)
    return segments.where(ok).withColumn("km", km).where("km > 0").groupBy(group).agg(F.sum("km").alias("km"))


def with_details(rows: DataFrame, first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """Rows with the fields of ``first`` by index, and those of ``second`` as one struct ``props`` (null where there are none)."""
    other = [c for c in second.columns if c != on]
    return rows.join(first, on, "left").join(second.select(on, F.struct(*other).alias("props")), on, "left")


def runs_or(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, first, last): cells that runs (row, first, last; last included) of either side cover, as maximal runs; one sort per row of cells."""
    x = a.select("row", "first", "last").unionByName(b.select("row", "first", "last")).where("last >= first")
    w = Window.partitionBy("row").orderBy("first", "last")
    x = x.withColumn("__p", F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__n", (F.col("__p").isNull() | (F.col("first") > F.col("__p") + 1)).cast("int"))
    return x.withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "__g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__g")


def runs_and(runs: DataFrame, mask: DataFrame, chunk: int = 64) -> DataFrame:
    """Runs (row, first, last, ...) cut to where the mask's runs (row, first, last, each cell in one run at most) are; joined by stretches of ``chunk`` cells."""
    part = lambda d: d.withColumn("__c", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor(F.col("last") / chunk))))
    m = part(mask.select("row", "first", "last")).select("row", "__c", F.col("first").alias("m0"), F.col("last").alias("m1"))
    j = part(runs.where("last >= first")).join(m, ["row", "__c"])
    lo, hi = F.greatest("first", "m0"), F.least("last", "m1")
    # a pair of runs that meets in several stretches is counted in the one where it begins
    j = j.withColumn("__a", lo).withColumn("__b", hi).where((F.col("__a") <= F.col("__b")) & (F.floor(F.col("__a") / chunk) == F.col("__c")))
    return j.select(*[F.col("__a").alias(c) if c == "first" else F.col("__b").alias(c) if c == "last" else F.col(c) for c in runs.columns])


def merge_tiles(parts: list[DataFrame]) -> DataFrame:
    """Features (z, x, y, layer, feature, ...) of several sources' tiles as one: layers of one name are joined, in the order of the sources."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("z", "x", "y", "layer").orderBy("source", "feature")))


MORTON_ZOOM = 16


def morton_code(lon: Column, lat: Column) -> Column:
    """Morton code of a point's tile at zoom 16."""
    return tiles.morton(tiles.tile_x(lon, MORTON_ZOOM), tiles.tile_y(lat, MORTON_ZOOM), MORTON_ZOOM)


def tile_run(z: int, x: int, y: int) -> tuple[int, int]:
    """First code and the one after the last of the points in a tile: points sorted by code have any tile's in one run.  Beyond zoom 16 it is that of the ancestor."""
    if z > MORTON_ZOOM:
        x, y, z = x >> (z - MORTON_ZOOM), y >> (z - MORTON_ZOOM), MORTON_ZOOM
    code = sum(((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1) for i in range(z))
    side = 2 * (MORTON_ZOOM - z)
    return code << side, (code + 1) << side


def write_by_code(points: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    """Points in the order of their code, in ranges of it, so that a tile is read from few row groups."""
    points.withColumn("code", morton_code(F.col(lon), F.col(lat))).repartitionByRange("code").sortWithinPartitions("code").write.mode("overwrite").parquet(path)


def points_in_tile(points: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """Points (with ``code``) of a tile; a plain range, so it reaches the statistics of the row groups."""
    first, end = tile_run(z, x, y)
    return points.where((F.col("code") >= first) & (F.col("code") < end))


def terrain_distribution(samples: DataFrame, value: str, low: float, high: float, bins: int, water: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, bin, weight): values by ground area; samples: z, y (tile), row (0..1 within the tile), value.  A sample weighs the square of the cosine of its latitude over
    two to the zoom; ``water`` (boolean) rows and unknown values don't count, values beyond the ends count in the first and last bin."""
    n = F.pow(F.lit(2.0), F.col("z"))
    lat = F.atan(F.sinh(math.pi * (1.0 - 2.0 * (F.col("y") + F.col("row")) / n)))
    x = samples.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    x = x.where(~F.coalesce(F.col(water), F.lit(False))) if water else x
    at = clamp(F.floor((F.col(value) - low) * bins / (high - low)).cast("double"), 0.0, float(bins - 1)).cast("int")
    return x.groupBy(*(by or []), at.alias("bin")).agg(F.sum(F.pow(F.cos(lat) / n, F.lit(2.0))).alias("weight"))
