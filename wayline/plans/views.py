"""The map's queries and details on the test tables: line items stand for samples along suppliers' roads, parts and orders for ways and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import tags as G
from wayline.operators import details as D
from wayline.operators import sequences as Q
from wayline.operators import timetables as T
from wayline.operators import views as V
from wayline.plans.landmarks import marks, view_sql
from wayline.session import cut, table
from wayline.sources import line_tiles as R

DRIVE_BOX, RIDE_BOX, MARK_BOX = (-20.0, -35.0, 25.0, 40.0), (-30.0, -50.0, 30.0, 45.0), (-60.0, -40.0, 80.0, 60.0)
DRIVE_WEIGHTS = [1.0, 0.8, 0.6, 0.5, 0.3, 0.4, 0.2, 0.3, -0.5, -0.3, 1.0, 0.5]
RIDE_WEIGHTS = [1.0, 0.8, 0.6, 0.5, 0.3, 0.4, 0.2, -0.3, 0.5, 0.3, 0.7]


def road_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples some 175 m apart along a road per supplier; a way every two kilometres.  They stand in for a table, so queries that read it several times write it once."""
    off = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("road"), off.alias("off")).distinct()
    ch = F.array(*[((F.col("off") * (7 + 2 * i) + 13 * i) % 256).cast("int") for i in range(13)])
    return x.select(
        "road", "off", (F.col("road") * 100_000 + F.floor(F.col("off") / 2000)).alias("way"), ((F.col("off") % 7000) / 100.0 - 35.0).alias("lon"), ((F.col("road") * 37 % 120) - 60 + (F.col("off") % 100) / 100.0).alias("lat"),
        ch.alias("ch"), ((F.col("off") * 13 % 400) / 10.0).alias("eye"), (F.col("off") % 8).cast("int").alias("flags"),
    )


def road_ways(samples: DataFrame) -> DataFrame:
    w = F.col("way")
    return samples.select("way").distinct().select(
        "way", (w % 15).cast("int").alias("class"), (w % 16).cast("int").alias("flags"), F.concat(F.lit("W"), w % 50).alias("name"), F.concat(F.lit("A"), w % 9).alias("ref"), (w % 4000).cast("double").alias("road_m"),
    )


def rail_ways(samples: DataFrame) -> DataFrame:
    w = F.col("way")
    road = F.floor(w / 100_000)
    return samples.select("way").distinct().select(
        "way", (10 + w % 5).cast("int").alias("class"), (w % 7 * (w % 3)).cast("int").alias("rail"),
        F.when(road % 3 == 0, "").when(road % 3 == 1, F.concat(F.lit("Line "), road % 7, F.lit(": X => Y"))).otherwise(F.concat(F.lit("B"), road % 5, F.lit(" => C"), road % 4)).alias("name"),
        F.concat(F.lit("R"), road % 6, F.lit(" · more")).alias("route"), (w % 1000).cast("int").alias("colour"), (w % 77).alias("rel"),
    )


def drives_view(spark: SparkSession, d: str) -> DataFrame:
    """The drives query."""
    s = cut(road_samples(spark, d))
    x = V.drives(s, cut(road_ways(s)), DRIVE_BOX, DRIVE_WEIGHTS, length_km=0.5, limit=20, surface=3, toll=3, unnamed=0b101, least=3, most=45)
    return x.select(
        "place", F.round("score", 4).alias("score"), "length_m", "road", "off0", "off1", "way", "mid_way", "name", "ref", "class", F.size("geom").alias("points"), "total",
        F.round(F.col("parts")[0], 6).alias("view"), F.round(F.col("parts")[4], 6).alias("above"), F.round(F.col("parts")[10], 6).alias("scenic"), F.round("at.lon", 6).alias("lon"),
    )


def rides_view(spark: SparkSession, d: str) -> DataFrame:
    """The rides query."""
    s = cut(road_samples(spark, d))
    w = cut(rail_ways(s))
    trains = w.select("way", (F.col("way") % 60 - 10).cast("double").alias("trains"))
    x = V.rides(s, w, trains, RIDE_BOX, RIDE_WEIGHTS, length_km=0.5, limit=30, groups=0b0110)
    return x.select("place", F.round("score", 4).alias("score"), "length_m", "road", "off0", "off1", "way", "line", "rel", "services", "colour", "trains", "total", F.round(F.col("parts")[8], 6).alias("grade"), F.round(F.col("parts")[10], 6).alias("often"))


def window_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The points of windows of three bins, by their first, middle and last samples."""
    s = road_samples(spark, d).select("road", "off", "lon", "lat")
    at, mid = F.struct("off", "lon", "lat"), F.abs(F.col("off") - F.floor(F.col("off") / 2000) * 2000 - 1000)
    bins = s.groupBy("road", F.floor(F.col("off") / 2000).alias("k")).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.min_by(at, F.struct(mid, "off")).alias("m"))
    pts = bins.select("road", F.explode(F.array_distinct(F.array("a", "m", "b"))).alias("p")).select("road", "p.*")
    w = bins.select("road", (F.col("a.off") + 300).alias("off0"), (F.col("b.off") + 500).alias("off1"), F.col("a.off").alias("lo"), (F.col("b.off") + 2000).alias("hi"))
    x = V.window_geometry(pts, w)
    return x.select("road", "off0", "off1", F.size("geom").alias("points"), F.round(F.col("geom")[0]["lon"], 4).alias("first"), F.round(F.element_at("geom", -1)["lon"], 4).alias("last"))


def _view(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k = F.col("id")
    m = marks(spark, d).withColumns({"rank": k, "kz": (k % 8).cast("int"), "tier": F.concat(F.lit("t"), k % 5), "flags": (k % 4).cast("int"), "size": F.when(k % 6 > 0, (k * 31 % 500).cast("double"))})
    size = {"size": (F.col("size"), 0.0, 500.0), "fa": (F.col("fa"), 0.0, 5.0)}
    return V.marks_view(m, MARK_BOX, ["BUILDING", "MACHINERY", "FURNITURE"], 0.25, 8, (5, 40), {"BUILDING": ["t1", "t3"]}, {"MACHINERY": {"size": (50.0, 400.0), "fa": (1.0, None)}, "FURNITURE": {"fa": (None, 3.9)}}, ("MACHINERY",), {"MACHINERY": size}, 4, None)


def marks_histogram(spark: SparkSession, d: str) -> DataFrame:
    """G6 in a view."""
    return _view(spark, d)["histogram"]


def marks_ranks(spark: SparkSession, d: str) -> DataFrame:
    """G9 in a view."""
    return _view(spark, d)["at_ranks"].select("rank", F.round("score", 6).alias("score"))


def marks_kinds(spark: SparkSession, d: str) -> DataFrame:
    """G8 in a view, with the best-known named one of each kind."""
    return _view(spark, d)["by_kind"]


def marks_top(spark: SparkSession, d: str) -> DataFrame:
    """The first of all, and of each kind."""
    v = _view(spark, d)
    one = v["top"].select(F.lit("").alias("list"), "kind", "id", F.round("score", 6).alias("score"))
    return one.unionByName(v["top_by_kind"].select(F.col("kind").alias("list"), "kind", "id", F.round("score", 6).alias("score")))


def marks_filters(spark: SparkSession, d: str) -> DataFrame:
    """G7 in a view."""
    return _view(spark, d)["filters"]


def marks_extra(spark: SparkSession, d: str) -> DataFrame:
    """What the tiles up to zoom 4 lack."""
    return _view(spark, d)["extra"].select("kind", "id", "kz")


def park_answers(spark: SparkSession, d: str) -> DataFrame:
    """Parks by name and point."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    west, south = (s * 7919 % 36000) / 100.0 - 180.0, (s * 104729 % 17000) / 100.0 - 85.0
    parks = table(spark, d, "supplier").select(s.alias("park"), F.concat(F.lit(" Park "), s % 4).alias("name"), west.alias("west"), south.alias("south"), (west + 20.0 + s % 5).alias("east"), (south + 12.0).alias("north"), (240.0 + 12.0 * (s % 5)).alias("area"))
    asks = table(spark, d, "customer").select(c.alias("ask"), F.concat(F.lit("park "), c % 4).alias("name"), ((c * 7919 % 36000) / 100.0 - 180.0).alias("lon"), ((c * 104729 % 17000) / 100.0 - 85.0).alias("lat"))
    return V.park_at(parks, asks)


def place_search(spark: SparkSession, d: str) -> DataFrame:
    """Parts' names as places, searched by the beginnings of two words."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("place"), F.initcap("p_name").alias("name"), (F.col("p_size") % 8).alias("rank"), ((k * 7919 % 36000) / 100.0 - 180.0).alias("lon"), ((k * 104729 % 17000) / 100.0 - 85.0).alias("lat"))
    return V.find_places(V.place_index(p), "RI sm", 10.0, 45.0, 25).select("place", "name", "rank", F.round(F.col("m") / 1000, 1).alias("km"))


def way_details(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ways, their line items as vertices."""
    k = F.col("o_orderkey")
    w = table(spark, d, "orders").select(k.alias("way"), (k % 256).cast("int").alias("flags"), (k % 32).cast("int").alias("rail"), (k * 7919 % 16_777_216).cast("int").alias("colour"), "o_totalprice", (k % 100).alias("road"))
    w = w.select("way", "flags", "rail", "colour", F.col("o_totalprice").alias("length_m"), "road", (F.col("o_totalprice") * 2).alias("road_m"))
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("way"), (F.col("l_partkey") % 4000).cast("int").alias("height_dm"), (F.col("l_suppkey") % 4).cast("int").alias("source"))
    labels = spark.createDataFrame([(1, "fine"), (2, "coarse"), (3, "old")], "source int, label string")
    x = D.way_detail(w, v, labels)
    first = lambda c: F.get("sources", F.lit(0))[c]
    return x.select("way", *D.WAY_FLAGS, F.concat_ws("+", "rail").alias("rail"), "colour", "length_m", "elev_min", "elev_max", F.size("sources").alias("n_sources"), first("label").alias("label"), F.round(first("share"), 6).alias("share"), "road", "road_m")


MODES = ("elev", "grade", "view", "vista", "drama", "ridge", "curvy", "openness", "trees", "forest", "fields", "built", "bldg", "water")


def colour_modes(spark: SparkSession, d: str) -> DataFrame:
    """Mean values of the colour modes along each road."""
    s = road_samples(spark, d)
    return s.groupBy("road").agg(*[F.round(F.avg(D.colour_metric(m, F.col("eye"), F.lit(2.5), F.col("ch"))), 6).alias(m) for m in MODES])


def draw_orders(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of tiles in draw order."""
    k = F.col("l_partkey")
    cls, flags = (k % 15).cast("int"), (F.col("l_suppkey") % 16).cast("int")
    p = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").count().select((k % 300).alias("tile"), D.style_of(cls, flags).alias("style"), F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("lon"), F.col("l_suppkey").alias("lat"), k.alias("part"))
    return D.draw_order(p, "tile", "style", "way", "lon", "lat", "part").select("tile", "style", "way", "lon", "lat", "part", "place")


def water_alphas(spark: SparkSession, d: str) -> DataFrame:
    """P25."""
    k = F.col("p_partkey")
    rgb = lambda a, b, c: F.struct((k * a % 256).alias("r"), (k * b % 256).alias("g"), (k * c % 256).alias("b"))
    return table(spark, d, "part").select("p_partkey", F.round(D.water_alpha((k % 11) / 10.0, rgb(7, 11, 13), rgb(17, 19, 23)), 4).alias("alpha"))


def rail_lines_todo(spark: SparkSession, d: str) -> DataFrame:
    """Orders as relations, line items as their ways; priority is the length without trains."""
    k = F.col("o_orderkey")
    tags = F.create_map(
        F.lit("network"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Net"), k % 4)), F.lit("operator"), F.concat(F.lit("Op"), k % 5), F.lit("ref"), F.when(k % 2 == 0, F.concat(F.lit("S"), k % 300)).otherwise(""),
        F.lit("from"), F.when(k % 7 > 0, F.concat(F.lit("T"), k % 40)).otherwise(""), F.lit("to"), F.concat(F.lit("T"), (k * 3) % 40), F.lit("name"), F.concat(F.lit("Line "), k), F.lit("service"), F.when(k % 50 == 0, "freight").otherwise("commuter"),
    )
    r = table(spark, d, "orders").select(k.alias("id"), tags.alias("tags"))
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("way"))
    w = table(spark, d, "part").select(F.col("p_partkey").alias("way"), (F.col("p_size") * 100.0).alias("metres"), (F.col("p_partkey") % 3 > 0).alias("served"))
    x = D.rail_todo(r, m, w).withColumn("priority", F.round(F.col("km") - F.col("served_km"), 1))
    return D.todo_order(x.withColumn("kind", F.lit("rail")), "priority", "kind", "osm")


def site_dots(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sites, parts as their components."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    parts = table(spark, d, "part").select(k.alias("id"), F.when(k % 3 > 0, k % 90).alias("site"), (k % 50).cast("double").alias("lon"), (k % 20).cast("double").alias("lat"), F.concat(F.lit("N"), k).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("C"), k)).alias("component"))
    sites = table(spark, d, "supplier").where("s_suppkey < 60").select(s.alias("site"), (s + 0.5).alias("lon"), (s * 0.25).alias("lat"), (s % 50).cast("double").alias("lead_lon"), (s % 20).cast("double").alias("lead_lat"), (s % 9 + 2).cast("int").alias("n"))
    return D.merged_sites(parts, sites)


def register_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sights by layer, with their bounds."""
    s = table(spark, d, "sights").select(F.lower(F.col("layer")).alias("register"), F.get("lnglat", F.lit(0)).alias("lon"), F.get("lnglat", F.lit(1)).alias("lat"))
    return D.register_summary(s, "register", "lon", "lat").select("register", "n", "placed", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


def km_in_view(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ferry segments, by priority."""
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("service"), (k * 7919 % 360 - 180).cast("double").alias("x0"), (k * 104729 % 160 - 80).cast("double").alias("y0"), (k * 7919 % 360 - 180 + k % 9 - 4).cast("double").alias("x1"), (k * 104729 % 160 - 80 + k % 5 - 2).cast("double").alias("y1"))
    return D.km_in_box(s, "service", (-40.0, -30.0, 50.0, 45.0)).select("service", F.round("km", 3).alias("km"))


def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts with two sets of details by index."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("i"), "p_name")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), "o_orderstatus")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), "c_mktsegment", "c_nationkey")
    return D.with_details(p, o, c, "i").select("i", "p_name", "o_orderstatus", F.col("props.c_mktsegment").alias("segment"), F.col("props.c_nationkey").alias("nation"))


def _runs(spark: SparkSession, d: str, part: int) -> DataFrame:
    li, k = table(spark, d, "lineitem"), F.col("l_partkey")
    return li.where(f"l_linenumber % 2 = {part}").select((F.col("l_suppkey") % 64).alias("row"), (k * 13 % 20_000).alias("first"), (k * 13 % 20_000 + F.col("l_quantity").cast("int") % 7).alias("last"))


def run_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Cells of two sets of runs, either and both."""
    a, b = _runs(spark, d, 0), _runs(spark, d, 1)
    one, two = D.runs_or(a, a.limit(0)), D.runs_or(b, b.limit(0))
    return D.runs_or(a, b).withColumn("how", F.lit("or")).unionByName(D.runs_and(one, two).withColumn("how", F.lit("and"))).select("how", "row", "first", "last")


def tile_merge(spark: SparkSession, d: str) -> DataFrame:
    """Features of two sources' tiles."""
    def of(name: str, key: str, label: str) -> DataFrame:
        k = F.col(key)
        return table(spark, d, name).select(F.lit(3).alias("z"), (k % 8).alias("x"), (k % 5).alias("y"), F.when(k % 3 == 0, "roads").otherwise(label).alias("layer"), k.alias("feature"))

    return D.merge_tiles([of("customer", "c_custkey", "names"), of("supplier", "s_suppkey", "water")])


def morton_counts(spark: SparkSession, d: str) -> DataFrame:
    """Points of some tiles, each as one run of codes."""
    p = marks(spark, d).withColumn("code", D.morton_code(F.col("lon"), F.col("lat")))
    out = None
    for z, x, y in ((0, 0, 0), (2, 1, 2), (3, 5, 3), (4, 9, 6)):
        n = D.points_in_tile(p, z, x, y).agg(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids")).select(F.lit(z).alias("z"), F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "ids")
        out = n if out is None else out.unionByName(n)
    return out


def terrain_weights(spark: SparkSession, d: str) -> DataFrame:
    """Line items as samples of tiles' heights."""
    k = F.col("l_partkey")
    s = table(spark, d, "lineitem").select(F.lit(6).alias("z"), (k % 64).alias("y"), ((F.col("l_linenumber") - 0.5) / 8).alias("row"), F.when(k % 9 > 0, F.col("l_extendedprice") / 50).alias("height"), (k % 5 == 0).alias("water"))
    return D.terrain_distribution(s, "height", 0.0, 1500.0, 64, "water").select("bin", F.round(F.col("weight") * 4096, 6).alias("weight"))


def line_tiles(spark: SparkSession, d: str) -> DataFrame:
    """roads' samples as lines of tiles, written as binary tiles and read back."""
    s = road_samples(spark, d).withColumn("x", (F.col("road") % 32).cast("int")).withColumn("y", (F.floor(F.col("off") / 20_000) % 16).cast("int"))
    pts = F.array_sort(F.collect_list(F.struct(F.col("off").cast("int").alias("px"), (F.col("eye") * 10).cast("int").alias("py"), F.col("ch"))))
    lines = s.groupBy("x", "y", "way").agg(pts.alias("p")).select(
        F.lit(9).alias("z"), "x", "y", "way", (F.col("way") % 16).cast("int").alias("style"), F.transform("p", lambda q: q["px"]).alias("xs"), F.transform("p", lambda q: q["py"]).alias("ys"),
        F.array(F.transform("p", lambda q: q["ch"][0]), F.transform("p", lambda q: q["ch"][4])).alias("channels"),
    )
    back = R.decode_tiles(R.encode_tiles(lines))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return back.select("z", "x", "y", "way", "style", F.size("xs").alias("points"), total("xs").alias("px"), total("ys").alias("py"), total(F.get("channels", F.lit(1))).alias("above"))


_PLACES = ("city", "town", "village", "suburb", "hamlet", "quarter", "neighbourhood", "locality", "isolated_dwelling", "farm")
_SERVICES = ("tourism", "heritage", "night", "high_speed", "regional", "commuter")
_ROUTES = ("train", "tram", "subway", "funicular", "bus", "light_rail")
_NAMES = ("Nightjet 40", "Local", "ICE Inter City", "Amtrak Acela", "Ring", "AVE Norte")


def tag_rules(spark: SparkSession, d: str) -> DataFrame:
    """P19, P23 and the text and language functions: ranks, people, service groups, own English names and languages, on tags made from parts."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.floor(k / n) % len(values)).cast("int"))
    some = lambda cond, value: F.when(cond, F.lit(value) if isinstance(value, str) else value)
    route = F.map_filter(F.create_map(F.lit("route"), pick(_ROUTES, 1), F.lit("service"), some(k % 3 == 0, pick(_SERVICES, 2)), F.lit("historic"), some(k % 13 == 0, "yes"), F.lit("name"), pick(_NAMES, 3), F.lit("operator"), some(k % 17 == 0, "Eurostar")), lambda _, v: v.isNotNull())
    own = F.map_filter(
        F.create_map(F.lit("name"), F.lit("東京"), F.lit("name:en"), some(k % 5 == 0, "Tokyo"), F.lit("name_en"), some(k % 7 == 0, " "), F.lit("name:ja_rm"), some(k % 3 == 0, "Tōkyō rm"), F.lit("name:ja-Latn"), some(k % 4 == 0, "Tōkyō"), F.lit("name:ja-Hira"), some(k % 2 == 0, "とうきょう"), F.lit("name:ja"), F.lit("東京"), F.lit("name:zh-Hant"), some(k % 3 == 1, "東京"), F.lit("l"), some(k % 11 == 0, "ko, ja,x")),
        lambda _, v: v.isNotNull(),
    )
    people = F.when(k % 6 == 0, F.concat(k, F.lit(",500"))).when(k % 6 == 1, F.concat(k, F.lit(" 000;2001"))).when(k % 6 == 2, "about 5").when(k % 6 == 3, "-7").when(k % 6 == 4, F.concat(k, F.lit(".5")))
    x = table(spark, d, "part").select("p_partkey", pick(_PLACES, 1).alias("place"), people.alias("people"), route.alias("route"), own.alias("own"), F.when(k % 4 == 0, " No ").when(k % 4 == 1, "yes").when(k % 4 == 2, "0").alias("flag"))
    return x.select(
        "p_partkey", G.place_rank(F.col("place")).alias("rank"), G.population(F.col("people")).alias("people"), F.round(G.size_zoom(G.population(F.col("people")), k % 10 == 0), 4).alias("zoom"), G.service_group(F.col("route")).alias("grp"), G.own_english(F.col("own")).alias("english"),
        F.concat_ws(",", G.languages(F.lit("東京"), F.col("own"))).alias("langs"), G.truthy(F.col("flag")).alias("flag"), T.mode_of((k % 1500).cast("string")).alias("mode"),
    )


def yearly_services(spark: SparkSession, d: str) -> DataFrame:
    """Days a year of calendars without a year; customers as services."""
    k = F.col("c_custkey")
    md = lambda c: F.concat(F.lit("2019"), F.lpad((c % 12 + 1).cast("string"), 2, "0"), F.lpad((c % 29 + 1).cast("string"), 2, "0"))
    cal = table(spark, d, "customer").select(k.cast("string").alias("service_id"), *[(k % (i + 2) == 0).cast("int").cast("string").alias(n) for i, n in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))], F.when(k % 40 == 7, "x").otherwise(md(k * 7)).alias("start_date"), md(k * 5).alias("end_date"))
    return T.yearly_dates(cal).groupBy("service_id").agg(F.count("*").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))


def ferry_services(spark: SparkSession, d: str) -> DataFrame:
    """How often suppliers ship, as ferry lines with two directions."""
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("line"), (F.col("l_linenumber") % 2).alias("way"), F.to_date("l_shipdate").alias("date"))
    return T.service_stats(li, "line", "way", "date").select("line", "daily", F.round("per_day", 6).alias("per_day"), "weekdays")


QUERIES = {
    f.__name__: f
    for f in (
        drives_view, rides_view, window_shapes, marks_histogram, marks_ranks, marks_kinds, marks_top, marks_filters, marks_extra, park_answers, place_search, way_details, colour_modes, draw_orders, water_alphas, rail_lines_todo, site_dots,
        register_counts, km_in_view, detail_rows, run_algebra, tile_merge, morton_counts, terrain_weights, tag_rules, yearly_services, ferry_services, line_tiles,
    )
}


_SAMP = "s as (select distinct l_suppkey as road, l_orderkey * 7 + l_linenumber as off from lineitem), smp as (select road, off, road * 100000 + off // 2000 as way, (off % 7000) / 100.0 - 35 as lon, (road * 37 % 120) - 60 + (off % 100) / 100.0 as lat from s)"
_CHAN = ", ".join(f"cast((off * {7 + 2 * i} + {13 * i}) % 256 as double) as c{i}" for i in range(13))


def _best(source: str, length: int = 500, gap: int = 300) -> str:
    """The best stretch of each run of ``source`` (road, off, way, score, seen, ...)."""
    return f"""lagged as (select *, lag(off) over (partition by road order by off) as p from {source}),
marked as (select *, case when p is null or off - p > {gap} then off end as st from lagged),
r as (select *, max(st) over (partition by road order by off rows unbounded preceding) as run from marked),
sc as (select * from {{scored}}),
ix as (select *, row_number() over (partition by road, run order by off) as i, sum(score) over (partition by road, run order by off rows unbounded preceding) as pre from sc),
jx as (select *, min(i) over (partition by road, run order by off range between {length} following and unbounded following) as j from ix),
hit as (select a.road, a.run, a.i, b.i as j, a.off as off0, b.off as off1, (b.pre - a.pre + a.score) / (b.i - a.i + 1) as mean, a.way, m.way as mid_way, a.lon, m.off as mid_off
  from jx a join ix b on b.road = a.road and b.run = a.run and b.i = a.j join ix m on m.road = a.road and m.run = a.run and m.i = (a.i + b.i) // 2 where m.seen),
best as (select * from (select *, row_number() over (partition by road, run order by mean desc, i) as rn from hit) where rn = 1)"""


_BOX = lambda b: view_sql([(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])])
_DPARTS = ["c0 / 255", "c1 / 255", "c8 / 255", "least(c2 / 200, 1)", "least(greatest((c3 - 128) / 30, 0), 1)", "least(c4 / 100, 1)", "1 - c5 / 255", "c10 / 255", "c6 / 255", "c12 / 255", "(case when fl & 1 > 0 then 1 else 0 end)", "(case when fl & 4 > 0 then 1 else 0 end)"]
_DSUM = " + ".join(f"({w}) * ({p})" for w, p in zip(DRIVE_WEIGHTS, _DPARTS))
_DPOS = sum(max(w, 0) for w in DRIVE_WEIGHTS)
_RPARTS = ["c0 / 255", "c1 / 255", "c8 / 255", "least(c2 / 200, 1)", "least(abs(c3 - 128) / 30, 1)", "least(greatest((eye - 3) / 1500, 0), 1)", "(case when sf & 2 > 0 then 0.5 else 0 end)", "(case when sf & 1 > 0 then 1 else 0 end)", "least(grade / 4, 1)", "least(c4 / 100, 1)", "(case when tr > 0 then least(log10(greatest(tr, 1)) / 2, 1) else 0 end)"]
_RSUM = " + ".join(f"({w}) * ({p})" for w, p in zip(RIDE_WEIGHTS, _RPARTS))
_RPOS = sum(max(w, 0) for w in RIDE_WEIGHTS[:-1])
_DRIVES = f"""{_SAMP}, w as (select distinct way, cast(way % 15 as int) as class, cast(way % 16 as int) as flags, 'W' || (way % 50) as name, 'A' || (way % 9) as ref, way % 4000 as m from smp),
kept as (select smp.*, class, name, ref, {_CHAN}, cast((off * 21 + 91) % 256 as int) as fl from smp join w using (way) where flags & 8 = 0 and not (flags & 4 > 0 and (5 >> class) & 1 = 1) and m between 3 and 45),
""" + _best("kept").replace("{scored}", f"(select *, least(greatest(({_DSUM}) / {_DPOS!r}, 0), 1) as score, {_BOX(DRIVE_BOX)} as seen from r)")
_RIDES = f"""{_SAMP}, w as (select distinct way, cast(10 + way % 5 as int) as class, cast(way % 7 * (way % 3) as int) as rail, case way // 100000 % 3 when 0 then 'R' || (way // 100000 % 6) when 1 then 'Line ' || (way // 100000 % 7) else 'B' || (way // 100000 % 5) || ' – C' || (way // 100000 % 4) end as line,
  'R' || (way // 100000 % 6) || ' · more' as services, cast(way % 1000 as int) as colour, way % 77 as rel, cast(way % 60 - 10 as double) as tr from smp),
kept as (select smp.*, class, line, services, colour, rel, tr, (off * 13 % 400) / 10.0 as eye, cast(off % 8 as int) as sf, {_CHAN} from smp join w using (way) where case when rail <> 0 then rail & 6 > 0 else (6 >> (class - 10)) & 1 = 1 end),
""" + _best("kept").replace("{scored}", f"""(select *, least(greatest(({_RSUM}) / ({_RPOS!r} + case when tr > 0 then 0.7 else 0 end), 0), 1) as score, {_BOX(RIDE_BOX)} as seen from (select *, least(abs(coalesce(lead(eye) over w2, eye) - coalesce(lag(eye) over w2, eye)) / greatest(abs(coalesce(lead(off) over w2, off) - coalesce(lag(off) over w2, off)), 1) * 100, 30) as grade from r window w2 as (partition by road, run order by off)))""")
_MV = f"""m as (select c_custkey as id, c_mktsegment as kind, (c_custkey * 7919 % 36000) / 100.0 - 180 as lon, (c_custkey * 104729 % 17000) / 100.0 - 85 as lat, log10(1 + greatest(c_acctbal, 0)) as fa, cast(c_custkey * 37 % 2000 + 1 as double) as ia,
  cast(c_custkey % 8 as int) as kz, c_custkey % 5 as tier, c_custkey % 4 as flags, case when c_custkey % 6 > 0 then cast(c_custkey * 31 % 500 as double) end as size from customer),
v as (select *, case kind when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end as qi from m where kind in ('BUILDING', 'MACHINERY', 'FURNITURE') and flags & 2 = 0 and {_BOX(MARK_BOX)} and not (kind = 'BUILDING' and tier in (1, 3))),
c as (select *, 0.75 * least(fa / 5, 1) + 0.25 * least(greatest((log10(greatest(ia, 0.05)) + 1.3) / 5.6, 0), 1) as score from v where case kind when 'MACHINERY' then coalesce(size between 50 and 400, true) and fa >= 1 when 'FURNITURE' then fa <= 3.9 else true end)"""


def _values(names: tuple[str, ...], n: int) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][p_partkey // {n} % {len(names)} + 1]"


_WORDS = " or ".join(f"contains(txt, '{w}')" for w in G.INTERCITY_WORDS)
_RANK = "case place " + " ".join(f"when '{k}' then {v}" for k, v in G.PLACE_RANKS.items()) + " end"
SQL = {
    "drives_view": f"""with {_DRIVES}, top as (select *, row_number() over (order by mean desc, road, off0) as place, (select count(*) from best) as total from best order by mean desc, road, off0 limit 20),
p as (select t.place, avg(c0 / 255) as view, avg(least(greatest((c3 - 128) / 30, 0), 1)) as above, avg(case when fl & 1 > 0 then 1 else 0 end) as scenic, count(*) as points from top t join kept k on k.road = t.road and k.off between t.off0 and t.off1 group by t.place)
select cast(t.place as int) as place, round(mean * 100, 4) as score, off1 - off0 as length_m, road, off0, off1, t.way, mid_way, w.name, w.ref, w.class, cast(points as int) as points, total, round(view, 6) as view, round(above, 6) as above, round(scenic, 6) as scenic, round(lon, 6) as lon
from top t join p using (place) join w on w.way = t.mid_way""",
    "rides_view": f"""with {_RIDES}, fl as (select road, run, arg_min(line, off) as line from r group by road, run), bl as (select b.*, fl.line from best b join fl using (road, run)),
one as (select * from (select *, row_number() over (partition by line order by mean desc, road, off0) as rl from bl) where rl = 1),
top as (select *, row_number() over (order by mean desc, road, off0) as place, (select count(*) from one) as total from one order by mean desc, road, off0 limit 30),
p as (select t.place, avg(least(grade / 4, 1)) as grade, avg(case when tr > 0 then least(log10(greatest(tr, 1)) / 2, 1) else 0 end) as often from top t join sc k on k.road = t.road and k.off between t.off0 and t.off1 group by t.place)
select cast(t.place as int) as place, round(mean * 100, 4) as score, off1 - off0 as length_m, road, off0, off1, t.way, t.line, w.rel, w.services, w.colour, w.tr as trains, total, round(grade, 6) as grade, round(often, 6) as often from top t join p using (place) join w on w.way = t.mid_way""",
    "window_shapes": f"""with {_SAMP}, b as (select road, off // 2000 as k, min(off) as a, max(off) as b, arg_min(off, (abs(off - off // 2000 * 2000 - 1000), off)) as m from smp group by 1, 2),
p as (select distinct smp.road, smp.off, smp.lon from smp join b on b.road = smp.road and smp.off in (b.a, b.b, b.m)), w as (select road, a + 300 as off0, b + 500 as off1, a as lo, b + 2000 as hi from b),
j as (select w.*, p.off, p.lon from w join p on p.road = w.road and p.off between lo and hi),
e as (select road, off0, off1, arg_min(off, (abs(off - off0), off)) as x, arg_min(off, (abs(off - off1), off)) as y from j group by 1, 2, 3)
select j.road, j.off0, j.off1, cast(count(*) as int) as points, round(arg_min(lon, off), 4) as first, round(arg_max(lon, off), 4) as last from j join e using (road, off0, off1) where off between least(x, y) and greatest(x, y) group by 1, 2, 3""",
    "marks_histogram": f"with {_MV} select cast(least(greatest(floor(score * 512), 0), 511) as int) as bin, count(*) as n from c group by 1",
    "marks_ranks": f"with {_MV}, o as (select score, row_number() over (order by score desc) as k, count(*) over () as n from c) select r as rank, round(score, 6) as score from (values (5), (40)) t(r) join o on k = least(r, n)",
    "marks_kinds": f"with {_MV} select kind, count(*) as n, arg_min(id, (-fa, id)) filter (flags & 1 > 0) as best from c group by kind",
    "marks_top": f"with {_MV}, o as (select *, row_number() over (order by score desc, qi, id) as k, row_number() over (partition by kind order by score desc, id) as kk from c) select '' as list, kind, id, round(score, 6) as score from o where k <= 8 union all select kind, kind, id, round(score, 6) from o where kk <= 8",
    "marks_filters": f"""with {_MV}, f as (select size, fa, coalesce(size between 50 and 400, true) as ks, fa >= 1 as kf from v where kind = 'MACHINERY')
select 'MACHINERY' as kind, 'size' as filter, cast(least(greatest(floor(size / 500 * 128), 0), 127) as int) as bin, count(*) as n from f where kf and size is not null group by 3 union all select 'MACHINERY', 'fa', cast(least(greatest(floor(fa / 5 * 128), 0), 127) as int), count(*) from f where ks group by 3""",
    "marks_extra": f"with {_MV}, o as (select score, row_number() over (order by score desc) as k, count(*) over () as n from c), l as (select max(score) as hi, min(score) as lo from o where k in (least(5, n), least(40, n))) select kind, id, kz from c where kz > 4 and score > (select case when hi - lo >= 0.02 then lo else greatest((lo + hi) / 2 - 0.01, 0) end from l) order by score desc, qi, id limit 5000",
    "park_answers": """with p as (select s_suppkey as park, 'park ' || (s_suppkey % 4) as key, (s_suppkey * 7919 % 36000) / 100.0 - 180 as w, (s_suppkey * 104729 % 17000) / 100.0 - 85 as s, s_suppkey % 5 as k from supplier),
a as (select c_custkey as ask, 'park ' || (c_custkey % 4) as key, (c_custkey * 7919 % 36000) / 100.0 - 180 as lon, (c_custkey * 104729 % 17000) / 100.0 - 85 as lat from customer),
j as (select ask, park, 240.0 + 12 * k as area, lon between w - 0.002 and w + 20.0 + k + 0.002 and lat between s - 0.002 and s + 12.002 as ins, least(greatest(lon, w), w + 20.0 + k) as x, least(greatest(lat, s), s + 12.0) as y, lon, lat from a join p using (key)),
d as (select *, sqrt(pow(radians(x - lon) * cos(radians((lat + y) / 2)), 2) + pow(radians(y - lat), 2)) * 6371008.8 as m from j)
select ask, arg_min(park, (case when ins then 0 else 1 end, case when ins then area else m end, park)) as park from d where ins or m < 5000 group by ask""",
    "place_search": """with p as (select p_partkey as place, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) as name, p_name, p_size % 8 as rank,
  (p_partkey * 7919 % 36000) / 100.0 - 180 as lon, (p_partkey * 104729 % 17000) / 100.0 - 85 as lat from part)
select place, name, rank, round(m / 1000, 1) as km from (select *, sqrt(pow(radians(10 - lon) * cos(radians((lat + 45) / 2)), 2) + pow(radians(45 - lat), 2)) * 6371008.8 as m from p where regexp_matches(p_name, '(^| )ri') and regexp_matches(p_name, '(^| )sm') order by rank desc, m, place limit 25)""",
    "way_details": """with v as (select l_orderkey as way, l_partkey % 4000 as h, l_suppkey % 4 as s from lineitem), t as (select way, min(h) / 10 as elev_min, max(h) / 10 as elev_max, count(*) as n, count(distinct s) filter (s > 0) as n_sources, min(s) filter (s > 0) as f from v group by way),
f as (select t.way, count(*) as k from t join v on v.way = t.way and v.s = t.f group by t.way), o as (select *, o_orderkey % 256 as fl, o_orderkey % 32 as r, o_orderkey * 7919 % 16777216 as c from orders)
select o_orderkey as way, fl & 1 > 0 as link, fl & 2 > 0 as bridge, fl & 4 > 0 as tunnel, fl & 8 > 0 as unpaved, fl & 16 > 0 as oneway, fl & 32 > 0 as toll, fl & 64 > 0 as scenic, fl & 128 > 0 as covered,
  array_to_string(list_filter([case when r & 1 > 0 then 'tram' end, case when r & 2 > 0 then 'metro' end, case when r & 4 > 0 then 'commuter' end, case when r & 8 > 0 then 'intercity' end, case when r & 16 > 0 then 'heritage' end], lambda x: x is not null), '+') as rail,
  case when c <> 0 then '#' || lpad(printf('%x', c), 6, '0') else '' end as colour, o_totalprice as length_m, elev_min, elev_max, cast(n_sources as int) as n_sources, case t.f when 1 then 'fine' when 2 then 'coarse' when 3 then 'old' end as label, round(f.k / n, 6) as share, o_orderkey % 100 as road, o_totalprice * 2 as road_m
from o join t on t.way = o_orderkey left join f on f.way = o_orderkey""",
    "colour_modes": f"with {_SAMP}, c as (select road, (off * 13 % 400) / 10.0 as eye, {_CHAN} from smp) select road, " + ", ".join(
        f"round(avg({e}), 6) as {m}"
        for m, e in zip(MODES, ("eye", "2.5", "c0 / 255", "c8 / 17", "c2 * 3", "(c3 - 128) * 2", "c4 * 4", "100 - c5 / 2.55", "c11 / 8", "c10 / 2.55", "c9 / 2.55", "c6 / 2.55", "c12 / 2.55", "c1 / 255"))
    ) + " from c group by road",
    "draw_orders": """with p as (select distinct l_orderkey as way, l_linenumber as lon, l_suppkey as lat, l_partkey as part from lineitem),
s as (select *, part % 300 as tile, cast(part % 15 + (case when lat & 8 > 0 then 16 else 0 end) + (case when lat & 2 > 0 then 32 else 0 end) + (case when lat & 4 > 0 then 64 else 0 end) + (case when lat & 1 > 0 then 128 else 0 end) as int) as style from p)
select tile, style, way, lon, lat, part, cast(row_number() over (partition by tile order by (case when style & 15 = 9 or style & 64 > 0 then 0 when style & 32 > 0 then 2 else 1 end) * 16 + (style & 15), way, lon, lat, part) as int) as place from s""",
    "water_alphas": """with c as (select p_partkey, p_partkey % 11 / 10.0 as s, [p_partkey * 7 % 256, p_partkey * 11 % 256, p_partkey * 13 % 256] as w, [p_partkey * 17 % 256, p_partkey * 19 % 256, p_partkey * 23 % 256] as l from part),
n as (select p_partkey, s, list_transform(w, lambda v: case when v / 255 <= 0.04045 then v / 255 / 12.92 else pow((v / 255 + 0.055) / 1.055, 2.4) end) as w, list_transform(l, lambda v: case when v / 255 <= 0.04045 then v / 255 / 12.92 else pow((v / 255 + 0.055) / 1.055, 2.4) end) as l from c),
y as (select p_partkey, s, 0.2126 * w[1] + 0.7152 * w[2] + 0.0722 * w[3] as yw, 0.2126 * l[1] + 0.7152 * l[2] + 0.0722 * l[3] as yl from n),
e as (select p_partkey, s, list_transform([yw, yl, s * yw + (1 - s) * yl], lambda v: case when v <= 0.0031308 then v * 12.92 else 1.055 * pow(v, 1 / 2.4) - 0.055 end) as e from y)
select p_partkey, round(case when abs(e[1] - e[2]) < 1e-3 then s * 255 else least(greatest((e[3] - e[2]) / (e[1] - e[2]), 0), 1) * 255 end, 4) as alpha from e""",
    "rail_lines_todo": """with o as (select o_orderkey as k, case when o_orderkey % 3 = 0 then '' else 'Net' || (o_orderkey % 4) end as net, 'Op' || (o_orderkey % 5) as op, case when o_orderkey % 2 = 0 then 'S' || (o_orderkey % 300) else '' end as ref, case when o_orderkey % 7 > 0 then 'T' || (o_orderkey % 40) else '' end as a, 'T' || (o_orderkey * 3 % 40) as b from orders),
g as (select *, case when ref <> '' then 'ref|' || lower(case when net = '' then op else net end) || '|' || lower(ref) when a <> '' then 'ends|' || lower(case when net = '' then op else net end) || '|' || least(lower(a), lower(b)) || '|' || greatest(lower(a), lower(b)) else 'r|' || k end as line from o),
h as (select line, min(k) as osm, arg_min(ref, k) as ref, arg_min(op, k) as operator, bool_and(k % 50 <> 0) as passenger from g group by line),
w as (select distinct line, l_partkey as way from g join lineitem on l_orderkey = k), q as (select line, sum(p_size * 100.0) / 1000 as km, sum(case when way % 3 > 0 then p_size * 100.0 else 0 end) / 1000 as s from w join part on p_partkey = way group by line)
select osm, 'Line ' || osm as name, ref, operator, round(cast(km as double), 1) as km, round(cast(s as double), 1) as served_km, passenger, round(round(cast(km as double), 1) - round(cast(s as double), 1), 1) as priority, 'rail' as kind from h join q using (line) where km > 0 order by priority desc, osm""",
    "site_dots": """with p as (select p_partkey as id, case when p_partkey % 3 > 0 then p_partkey % 90 end as site, cast(p_partkey % 50 as double) as lon, cast(p_partkey % 20 as double) as lat, 'N' || p_partkey as name, case when p_partkey % 2 = 0 then 'C' || p_partkey end as component from part),
s as (select s_suppkey as site, s_suppkey + 0.5 as slon, s_suppkey * 0.25 as slat, s_suppkey % 50 as llon, s_suppkey % 20 as llat, s_suppkey % 9 + 2 as n from supplier where s_suppkey < 60), j as (select p.*, slon, slat, n, lon = llon and lat = llat as lead from p left join s using (site))
select min(id) as id, site, true as is_dot, cast(any_value(slon) as double) as lon, cast(any_value(slat) as double) as lat, arg_min(name, id) as name, cast(any_value(n) as int) as components from j where lead group by site
union all select id, site, case when slon is not null then false end, lon, lat, case when slon is not null then coalesce(component, name) else name end, null from j""",
    "register_counts": """with s as (select lower(layer) as register, lnglat[1] as lon, lnglat[2] as lat, lnglat[1] between -180 and 180 and lnglat[2] between -90 and 90 as ok from sights)
select register, count(*) as n, count(*) filter (ok) as placed, round(min(lon) filter (ok), 6) as west, round(min(lat) filter (ok), 6) as south, round(max(lon) filter (ok), 6) as east, round(max(lat) filter (ok), 6) as north from s group by register""",
    "km_in_view": """with s as (select o_orderpriority as service, cast(o_orderkey * 7919 % 360 - 180 as double) as x, cast(o_orderkey * 104729 % 160 - 80 as double) as y, o_orderkey % 9 - 4 as dx, o_orderkey % 5 - 2 as dy from orders),
t as (select *, greatest(0, coalesce(least((-40 - x) / nullif(dx, 0), (50 - x) / nullif(dx, 0)), 0), coalesce(least((-30 - y) / nullif(dy, 0), (45 - y) / nullif(dy, 0)), 0)) as a,
  least(1, coalesce(greatest((-40 - x) / nullif(dx, 0), (50 - x) / nullif(dx, 0)), 1), coalesce(greatest((-30 - y) / nullif(dy, 0), (45 - y) / nullif(dy, 0)), 1)) as b from s where (dx <> 0 or x between -40 and 50) and (dy <> 0 or y between -30 and 45)),
k as (select service, greatest(b - a, 0) * sqrt(pow(dx * 111.32 * cos(radians(y + dy / 2)), 2) + pow(dy * 110.57, 2)) as km from t) select service, round(sum(km), 3) as km from k where km > 0 group by service""",
    "detail_rows": "select p_partkey as i, p_name, o_orderstatus, c_mktsegment as segment, c_nationkey as nation from part left join orders on o_orderkey = p_partkey left join customer on c_custkey = p_partkey",
    "run_algebra": """with c as (select l_linenumber % 2 as side, l_suppkey % 64 as row, unnest(generate_series(l_partkey * 13 % 20000, l_partkey * 13 % 20000 + cast(l_quantity as int) % 7)) as x from lineitem),
o as (select distinct row, x from c), a as (select row, x from c where side = 0 intersect select row, x from c where side = 1),
pa as (select row, x, sum(n) over (partition by row order by x rows unbounded preceding) as g from (select row, x, case when lag(x) over (partition by row order by x) = x - 1 then 0 else 1 end as n from a)),
po as (select row, x, x - row_number() over (partition by row order by x) as g from o)
select 'or' as how, row, min(x) as first, max(x) as last from po group by row, g union all select 'and', row, min(x), max(x) from pa group by row, g""",
    "tile_merge": """with f as (select 0 as source, c_custkey as feature, case when c_custkey % 3 = 0 then 'roads' else 'names' end as layer from customer union all select 1, s_suppkey, case when s_suppkey % 3 = 0 then 'roads' else 'water' end from supplier)
select 3 as z, feature % 8 as x, feature % 5 as y, layer, feature, source, cast(row_number() over (partition by feature % 8, feature % 5, layer order by source, feature) as int) as place from f""",
    "terrain_weights": """with s as (select l_partkey % 64 as y, (l_linenumber - 0.5) / 8 as r, l_extendedprice / 50 as h from lineitem where l_partkey % 9 > 0 and l_partkey % 5 <> 0)
select cast(least(greatest(floor(h * 64 / 1500), 0), 63) as int) as bin, round(sum(pow(cos(atan((exp(pi() * (1 - 2 * (y + r) / 64)) - exp(-pi() * (1 - 2 * (y + r) / 64))) / 2)) / 64, 2)) * 4096, 6) as weight from s group by 1""",
    "tag_rules": f"""with p as (select p_partkey, {_values(_PLACES, 1)} as place, {_values(_ROUTES, 1)} as route, case when p_partkey % 3 = 0 then {_values(_SERVICES, 2)} end as service, p_partkey % 13 = 0 as old, lower({_values(_NAMES, 3)} || '   ' || case when p_partkey % 17 = 0 then 'Eurostar' else '' end) as txt, p_partkey as k,
  cast(case p_partkey % 6 when 0 then p_partkey * 1000 + 500 when 1 then p_partkey * 1000 when 4 then p_partkey + 0.5 else 0 end as double) as people from part),
t as (select *, coalesce(service in ('tourism', 'heritage'), false) or old as tourist from p)
select p_partkey, {_RANK} as rank, people, round(case when people > 0 then 18 - 2 * log10(people) - case when k % 10 = 0 then 0.5 else 0 end end, 4) as zoom,
  case when route = 'tram' then case when tourist then 4 else 0 end when route in ('subway', 'light_rail') then 1 when route = 'funicular' then 4 when route = 'train' then case when tourist then 4 when service in ('night', 'high_speed') then 3 when service is not null then 2 when {_WORDS} then 3 else 2 end end as grp,
  case when k % 5 = 0 then 'Tokyo' when k % 4 = 0 then 'Tōkyō' when k % 3 = 0 then 'Tōkyō rm' when k % 2 = 0 then 'Tokyo' end as english, case when k % 11 = 0 then case when k % 3 = 1 then 'ja,ko,zh' else 'ja,ko' end when k % 3 = 1 then 'ja,zh' else 'ja' end as langs, k % 4 = 1 as flag,
  case when k % 1500 in (0, 5) or k % 1500 between 900 and 999 then 'tram' when k % 1500 in (1, 12) or k % 1500 between 400 and 499 then 'metro' when k % 1500 in (7, 116, 1400) then 'funicular' when k % 1500 = 2 or k % 1500 between 100 and 199 then 'rail'
    when k % 1500 in (4, 1000, 1200) then 'ferry' when k % 1500 = 3 or k % 1500 between 200 and 299 or k % 1500 between 700 and 799 then 'bus' else 'other' end as mode from t""",
    "line_tiles": f"with {_SAMP} select 9 as z, cast(road % 32 as int) as x, cast(off // 20000 % 16 as int) as y, way, cast(way % 16 as int) as style, cast(count(*) as int) as points, sum(off) as px, sum(off * 13 % 400) as py, sum((off * 15 + 52) % 256) as above from smp group by 1, 2, 3, 4",
    "yearly_services": """with c as (select c_custkey as k, c_custkey * 7 % 12 + 1 as m0, c_custkey * 7 % 29 + 1 as d0, c_custkey * 5 % 12 + 1 as m1, c_custkey * 5 % 29 + 1 as d1 from customer where c_custkey % 40 <> 7),
s as (select k, make_date(2001, m0, case when m0 = 2 then least(d0, 28) else d0 end) as a, make_date(2001, m1, case when m1 = 2 then least(d1, 28) else d1 end) as b from c),
d as (select k, cast(x as date) as d from s, (select unnest(generate_series(date '2001-01-01', date '2001-12-31', interval 1 day)) as x) where case when a <= b then x between a and b else x <= b or x >= a end)
select cast(k as varchar) as service_id, count(*) as days, min(d) as first, max(d) as last from d where k % (isodow(d) + 1) = 0 group by k""",
    "ferry_services": """with t as (select l_suppkey % 50 as line, l_linenumber % 2 as way, cast(l_shipdate as date) as d from lineitem), u as (select line, count(distinct way) as ways from t group by line),
dy as (select t.line, d, date_trunc('week', d) as w, count(*) / any_value(ways) as n from t join u using (line) group by t.line, d), wk as (select line, w, count(*) as days, sum(n) as n from dy group by 1, 2),
m as (select a.line, a.day, b.days, b.week, b.weeks from (select line, median(n) as day from dy group by line) a join (select line, median(days) as days, median(n) as week, count(*) as weeks from wk group by line) b using (line)),
wd as (select line, isodow(d) as x, count(distinct w) as k from dy group by 1, 2), o as (select wd.line, string_agg(x, '' order by x) as weekdays from wd join m using (line) where k * 2 >= weeks group by wd.line)
select m.line, days >= 4 and day >= 1 as daily, round(case when days >= 4 and day >= 1 then day else week / 7 end, 6) as per_day, coalesce(weekdays, '') as weekdays from m left join o using (line)""",
}
SQL["morton_counts"] = "with m as (select c_custkey as id, (c_custkey * 7919 % 36000) / 100.0 - 180 as lon, (c_custkey * 104729 % 17000) / 100.0 - 85 as lat from customer), t as (select id, " + "cast(least(greatest(floor((lon + 180) / 360 * 65536), 0), 65535) as bigint) as x, cast(least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536), 0), 65535) as bigint) as y from m) " + " union all ".join(
    f"select {z} as z, {x} as x, {y} as y, count(*) as n, coalesce(sum(id), 0) as ids from t where x >> {16 - z} = {x} and y >> {16 - z} = {y}" for z, x, y in ((0, 0, 0), (2, 1, 2), (3, 5, 3), (4, 9, 6))
)
