"""Sources and sinks.  register(spark) makes the formats known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    from wayline.sources.osm import OsmPbfSource
    from wayline.sources.pmtiles import PmtilesSource

    # without this Spark refuses readers that take filters
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in (PmtilesSource, OsmPbfSource):
        spark.dataSource.register(s)
