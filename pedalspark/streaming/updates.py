"""Street updates and accidents as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lts import edge_stress


def stress_updates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Streets with their stress as files of updates arrive: the rules need no state."""
    return edge_stress(spark.readStream.schema(schema).parquet(path))


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All files that are there, once each, as Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accident_counts(events: DataFrame, time: str = "ts", kind: str = "kind", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, kind, n) of accidents in windows; state for windows older than ``late`` goes."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
