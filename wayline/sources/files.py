"""Files of timetables, registers and elevations, and content-named outputs."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def open_file(path: str):
    """A file for reading by position, on the file system that its address names (a plain path is a local or mounted one)."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def read_gtfs(spark: SparkSession, path: str) -> DataFrame:
    """(feed, file, line, row map): the rows of every table of timetable zips.

    Names count without folders (of several files of one name the last), a byte-order mark and blanks round column names are dropped;
    short rows lack their last columns.  A zip that can't be read is one row with file null and the reason in row['error']."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                try:
                    z = zipfile.ZipFile(io.BytesIO(r.content))
                    names = {n.rsplit("/", 1)[-1]: n for n in z.namelist() if n.endswith(".txt")}
                    for name, full in sorted(names.items()):
                        rows = csv.reader(io.StringIO(z.read(full).decode("utf-8-sig", "replace"), newline=""))
                        head = [h.strip() for h in next(rows, [])]
                        out = [(r.path, name[:-4], i, dict(zip(head, row))) for i, row in enumerate(rows) if row]
                        for k in range(0, len(out), 5000):
                            yield pd.DataFrame(out[k : k + 5000], columns=["feed", "file", "line", "row"])
                except (zipfile.BadZipFile, csv.Error, OSError) as e:
                    yield pd.DataFrame([(r.path, None, 0, {"error": str(e)})], columns=["feed", "file", "line", "row"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "feed string, file string, line int, row map<string,string>")


def gtfs_table(rows: DataFrame, file: str, columns: list[str]) -> DataFrame:
    """One table of read_gtfs as text columns; missing columns are null."""
    return rows.where(F.col("file") == file).select("feed", *[F.col("row").getItem(c).alias(c) for c in columns])


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines or GeoJSON text sequences (record separators dropped); lines that don't parse are rows of nulls.
    Compression by extension (gz, zst) is Spark's."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\u001e", "")).alias("v")).where("v <> ''")
    return t.select(F.from_json("v", schema).alias("j")).select("j.*")


def terrarium_metres(red: Column, green: Column, blue: Column) -> Column:
    """Height of a terrarium pixel."""
    return red * 256.0 + green + blue / 256.0 - 32768.0


def terrarium_rgb(metres: Column) -> Column:
    """Pixel of a height, to 1/256 m."""
    v = F.round((metres + 32768.0) * 256.0).cast("long")
    return F.struct(F.floor(v / 65536).cast("int").alias("red"), (F.floor(v / 256) % 256).cast("int").alias("green"), (v % 256).cast("int").alias("blue"))


def distinct_blobs(df: DataFrame, data: str) -> tuple[DataFrame, DataFrame]:
    """Index and blobs: rows with the content hash of ``data`` in its place, and each content once."""
    named = df.withColumn("hash", F.sha2(F.col(data), 256))
    blobs = named.groupBy("hash").agg(F.any_value(data).alias("data"))
    return named.drop(data), blobs


def write_pack(df: DataFrame, path: str, data: str, partition: list[str] | None = None) -> None:
    """A pack: ``path``/index with the rows in order and ``path``/blobs with each content once, both replaced as a whole."""
    index, blobs = distinct_blobs(df, data)
    w = index.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(f"{path}/index")
    blobs.repartitionByRange("hash").sortWithinPartitions("hash").write.mode("overwrite").parquet(f"{path}/blobs")


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index").join(spark.read.parquet(f"{path}/blobs"), "hash")


def write_marks(df: DataFrame, path: str) -> None:
    """Landmark rows by kind and zoom-6 tile, sorted along the tile's Morton order so that boxes prune row groups."""
    from wayline.functions import tiles

    x, y = tiles.tile_x(F.col("lon"), 16), tiles.tile_y(F.col("lat"), 16)
    z6 = tiles.tile_key(F.lit(6), F.floor(x / 1024), F.floor(y / 1024))
    rows = df.withColumn("z6", z6).withColumn("__m", tiles.morton(x % 1024, y % 1024, 10))
    rows.repartition("kind", "z6").sortWithinPartitions("kind", "z6", "__m").drop("__m").write.mode("overwrite").partitionBy("kind").parquet(path)


def read_boxes(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, columns: list[str]) -> DataFrame:
    """Rows of a table with a bbox struct (xmin, ymin, xmax, ymax) that meet a box; the tests reach the row groups' statistics."""
    df = spark.read.parquet(path)
    return df.where((F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south)).select(*columns)
