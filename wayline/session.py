"""Session helpers: a local session for tests, reliable lineage cuts, table reads."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 4, app: str = "wayline") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only in local
    mode: on a cluster a machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not told:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = tempfile.mkdtemp(prefix="wayline-checkpoint-")
    sc.setCheckpointDir(told)
    return sc.getCheckpointDir()


def cut(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    A checkpoint remembers how its rows are laid out (partitioning, order, and every alias of those columns).
    In loops of joins that memory doubles with each round until planning takes minutes, so it is dropped
    unless ``keep_layout`` asks for it.
    """
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    if keep_layout:
        return kept
    spark = df.sparkSession
    inner = getattr(spark._jsparkSession, "internalCreateDataFrame", None)
    try:
        plain = inner(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    except Exception:  # noqa: BLE001  another Spark version: by way of the public call
        plain = spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema())
    return DataFrame(plain, spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` provably has at most ``max_rows`` rows (reads no more than that)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_checked(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` when it has at most ``max_rows`` rows, else ``df`` as it is,
    so that the planner takes a shuffled join."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, so that executors need not have it installed."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_wayline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="wayline-package-")) / "wayline.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("wayline") / p.relative_to(root))
    sc.addPyFile(str(to))
    sc._wayline_shipped = True
