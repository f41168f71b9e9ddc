"""Tables between the steps of iterative jobs, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A temporary folder stands in only on one machine, where the setting is unset, as in local tests; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        named = f"file://{tempfile.mkdtemp(prefix='steps-')}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone, and with it the need
        pass


@atexit.register
def release() -> None:
    """Remove all tables stored so far: for callers that have taken their results. It also runs when the driver ends."""
    while _made:
        _drop(*_made.pop())


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path, removed by ``release``."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back: its lineage ends here, and no executor holds the only copy."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
