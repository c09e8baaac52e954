"""Crowds on few places: what would be a pair of rows for every two of them must end in a minute, with right results."""

from threading import Timer

from pyspark.sql import functions as F

from wayline.operators import corridors as C
from wayline.operators import lookups as J
from wayline.operators import pyramids as P


def ended(spark, df, seconds=60):
    """The rows of df; jobs that take longer are cancelled, which is an error."""
    timer = Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()


def test_neighbour_heights_of_a_crowd(spark):
    k = F.col("id")
    asked = spark.range(400_000).select("id", (k % 2 * 1000.0).alias("x"), F.lit(0.0).alias("y"), F.when(k % 5 == 0, 50.0).otherwise(100.0).alias("area"))
    known = spark.range(200_000).select((k % 2 * 200.0).alias("x"), F.lit(0.0).alias("y"), F.lit(60.0).alias("area"), (30 + k % 2 * 2 + k % 3).cast("int").alias("h"))
    got = ended(spark, P.neighbour_heights(asked, known).groupBy(F.col("id") % 10, "near_dm").count())
    # at the crowd's own place within 150 m: heights 30 to 32; beyond 300 m: nothing
    assert sorted(map(tuple, got)) == [(k, 31, 40_000) for k in range(0, 10, 2)]


def test_neighbour_heights_far_stage(spark):
    # alike ones too few within 150 m: eight within 300 m count, for an asked one of 60 m² at least; the lower of two middle ones
    asked = spark.createDataFrame([(1, 0.0, 0.0, 60.0), (2, 0.0, 0.0, 59.0), (3, 5000.0, 0.0, 60.0)], "id long, x double, y double, area double")
    known = spark.createDataFrame([(250.0, 0.0, 500.0, h) for h in (40, 40, 50, 60, 70, 80, 90, 90)], "x double, y double, area double, h int")
    assert {r.id: r.near_dm for r in P.neighbour_heights(asked, known).collect()} == {1: 60, 2: None}


def test_parallel_tracks_of_a_crowd(spark):
    k = F.col("id")
    points = spark.range(600_000).select((k % 3 + k % 2 * 10).alias("track"), (k % 2 * 100.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("heading"), F.lit(0).alias("service"))
    got = ended(spark, C.parallel_tracks(points))
    assert sorted(map(tuple, got)) == [(a + z, b + z) for z in (0, 10) for a in range(3) for b in range(3) if a != b]


def test_frontage_of_a_crowd(spark):
    k = F.col("id")
    samples = spark.range(200_000).select("id", (k % 2 * 1000.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("heading"), (k % 4 == 2).alias("hidden"))
    boxes = spark.range(2_000).select((-100.0 - k * 0.01).alias("x0"), F.lit(10.0).alias("y0"), (100.0 + k * 0.01).alias("x1"), F.lit(20.0).alias("y1"))
    got = ended(spark, C.frontage(samples, boxes).groupBy(F.col("id") % 4, F.round("share", 6)).count())
    # boxes of the left side only, at most 30 m from every point; none near the second place; hidden ones have none
    assert sorted(map(tuple, got)) == [(0, 0.5, 50_000), (1, 0.0, 50_000), (2, 0.0, 50_000), (3, 0.0, 50_000)]


def test_overlay_picks_of_a_crowd(spark):
    k = F.col("id")
    boxes = spark.range(100_000).select("id", F.lit(0).alias("west"), F.lit(0).alias("south"), F.lit(5).alias("east"), F.lit(5).alias("north"))
    # ranks run against the order of rows; the odd ones contain the boxes, the even ones only meet them
    sets = spark.range(40_000).select(F.concat(F.lit("S"), k % 7).alias("name"), (40_000 - k).alias("rank"), (k % 2 * -10 + 3).alias("w"), F.lit(-1).alias("s"), F.lit(50).alias("e"), F.lit(50).alias("n"))
    got = ended(spark, J.overlay_picks(boxes, sets).groupBy("name", "rank").count())
    assert sorted(map(tuple, got)) == [("S1", 1, 100_000)]


def test_overlay_picks_of_datasets_of_one_name(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 5, 5), (2, 0, 0, 5, 5)], "id long, west int, south int, east int, north int")
    sets = spark.createDataFrame([("S", 1, 4, 4, 9, 9), ("S", 2, 90, 90, 99, 99), ("S", 3, 0, 0, 5, 5), ("T", 4, 0, 0, 5, 5)], "name string, rank int, w int, s int, e int, n int")
    assert sorted(map(tuple, J.overlay_picks(boxes, sets).collect())) == [(i, "S", r) for i in (1, 2) for r in (1, 3)]
