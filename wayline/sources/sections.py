"""Stores of named sections as Parquet tables with a manifest, and content-named files.

A section's rows have a place ``i`` from 0 in the section's order, so rows are read by place, by ranges of places or by equal values of a sorted column, all of
which reach the row groups' statistics.  The manifest holds each section's rows and digest and the store's version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.session import cut

CHUNK = 4096


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_atomic(spark: SparkSession, folder: str, data: bytes, suffix: str = "") -> str:
    """Writes ``data`` under the hash of its content and returns the name: to a temporary name first, which is renamed; content that is there already stays."""
    import hashlib

    name = hashlib.sha256(data).hexdigest()[:32] + suffix
    target, fs = _fs(spark, f"{folder}/{name}")
    if not fs.exists(target):
        temp = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if not fs.rename(temp, target):
            fs.delete(temp, False)
            if not fs.exists(target):
                raise OSError(f"can't name {name}")
    return name


def _digest(df: DataFrame) -> tuple[int, str]:
    cols = [F.to_json(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in sorted(df.dtypes)]
    n, h = df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    return n, str(h or 0)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``i``: the row's place from 0 in the order, by ranges of it and the counts of the ranges before; rows that tie are told apart by nothing else."""
    x = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    k = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return x.withColumn("__k", k).join(starts, "__p").withColumn("i", F.col("__start") + F.col("__k")).drop("__p", "__k", "__start")


def write_sections(spark: SparkSession, folder: str, sections: dict[str, tuple[DataFrame, list[str]]], version: int) -> None:
    """Writes each section (table, order) and, last, the manifest; without it there is no store."""
    manifest = {"version": version, "sections": {}}
    for name, (df, order) in sections.items():
        numbered(df, order).repartitionByRange("i").sortWithinPartitions("i").write.mode("overwrite").parquet(f"{folder}/{name}")
        n, h = _digest(spark.read.parquet(f"{folder}/{name}"))
        manifest["sections"][name] = {"rows": n, "digest": h}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_manifest")


class Sections:
    """A store that was written by write_sections; a wrong version or an absent section is a ValueError."""

    def __init__(self, spark: SparkSession, folder: str, version: int):
        self.spark, self.folder = spark, folder
        self.manifest = json.loads("".join(r.value for r in spark.read.text(f"{folder}/_manifest").collect()))
        if self.manifest["version"] != version:
            raise ValueError(f"version {self.manifest['version']}, not {version}")

    def table(self, name: str, columns: list[str] | None = None, check: bool = False) -> DataFrame:
        """A whole section, or some of its columns; ``check`` holds its content against the manifest first."""
        if name not in self.manifest["sections"]:
            raise ValueError(f"no section {name}")
        df = self.spark.read.parquet(f"{self.folder}/{name}")
        if check and _digest(df) != (self.manifest["sections"][name]["rows"], self.manifest["sections"][name]["digest"]):
            raise ValueError(f"section {name} isn't what was written")
        return df.select("i", *columns) if columns else df

    def part(self, name: str, first: int, n: int) -> DataFrame:
        return self.table(name).where((F.col("i") >= first) & (F.col("i") < first + n))

    def get_many(self, name: str, places: DataFrame) -> DataFrame:
        """Rows at the places (column i) asked for, each as often as it is asked for."""
        return places.select("i").join(self.table(name), "i")

    def gather(self, name: str, ranges: DataFrame) -> DataFrame:
        """(ask, rows): rows of ranges (ask, first, last; last excluded), joined by stretches of places."""
        part = lambda c: F.floor(c / CHUNK)
        r = ranges.where("last > first").withColumn("__c", F.explode(F.sequence(part(F.col("first")), part(F.col("last") - 1))))
        return r.join(self.table(name).withColumn("__c", part(F.col("i"))), "__c").where("i >= first and i < last").drop("__c", "first", "last")

    def equal_range(self, name: str, column: str, value) -> DataFrame:
        """Rows with a value in the column that the section is sorted by."""
        return self.table(name).where(F.col(column) == F.lit(value))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """(item, k, v, type): facts from query answers in the public JSON form of variables and bindings, one answer a file; every variable beside ``item`` is a fact.
    Bindings without an item and files that don't parse give none."""
    cell = "struct<type:string,value:string>"
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", f"results struct<bindings:array<map<string,{cell}>>>").alias("j"))
    b = t.select(F.explode("j.results.bindings").alias("b")).where("b['item'] is not null")
    x = b.select(F.regexp_extract(F.col("b")["item"]["value"], "([^/]+)$", 1).alias("item"), F.explode("b").alias("k", "c")).where("k <> 'item'")
    return x.select("item", "k", F.col("c.value").alias("v"), F.col("c.type").alias("type"))


def read_pageviews(spark: SparkSession, path: str) -> DataFrame:
    """(month, project, article, views): lines "project article views ..." of files named by their month (six digits, or four and two); unreadable lines are left out."""
    t = spark.read.text(path).select(F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([0-9]{4}-?[0-9]{2})[^/]*$", 1), "-", "").alias("month"), F.split("value", " ").alias("p"))
    return t.select("month", F.get("p", F.lit(0)).alias("project"), F.get("p", F.lit(1)).alias("article"), F.get("p", F.lit(2)).try_cast("long").alias("views")).where("views is not null and article <> ''")


def wanted_views(views: DataFrame, wanted: DataFrame) -> DataFrame:
    """(article, month, views): monthly views of the wanted articles in the months in which they have any."""
    return views.join(wanted.select("article").distinct(), "article", "left_semi").groupBy("article", "month").agg(F.sum("views").alias("views"))


#: Declarations are small files that people write.
MOST_DECLARATIONS = 10_000


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, key, value): TOML files' tables and TSV files' rows as text values; the entry is the table's name or the row's number."""
    import tomllib

    files = spark.read.format("binaryFile").load(path).select("path", "content").limit(MOST_DECLARATIONS + 1).collect()
    if len(files) > MOST_DECLARATIONS:
        raise ValueError(f"at most {MOST_DECLARATIONS} files")
    rows: list[tuple[str, str, str, str]] = []

    def put(file: str, entry: str, value) -> None:
        for k, v in value.items():
            if isinstance(v, dict):
                put(file, f"{entry}.{k}" if entry else k, v)
            elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
                for i, x in enumerate(v):
                    put(file, f"{entry}.{k}[{i}]" if entry else f"{k}[{i}]", x)
            else:
                rows.append((file, entry, k, json.dumps(v, ensure_ascii=False, default=str) if not isinstance(v, str) else v))

    for f in files:
        text = bytes(f.content).decode("utf-8-sig")
        if f.path.endswith(".tsv"):
            lines = [x.split("\t") for x in text.splitlines() if x.strip() and not x.startswith("#")]
            for i, line in enumerate(lines[1:]):
                rows += [(f.path, str(i), k, v) for k, v in zip(lines[0], line)]
        else:
            put(f.path, "", tomllib.loads(text))
    return spark.createDataFrame(rows, "file string, entry string, key string, value string")
