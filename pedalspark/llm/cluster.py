"""What operators need to know about the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..shipping import ship
from ..storage import stored, table_path

__all__ = ["prepare", "shuffle_partitions", "stored", "table_path"]

#: Bytes of rows that a task sends to its Python worker at once: each batch is held on both sides.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Put the package on the executors' path and keep Arrow batches of long texts small, unless the session says otherwise."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
