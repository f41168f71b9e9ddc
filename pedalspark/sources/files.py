"""Binary files of whole formats: read through Spark, one file a row; written by the tasks, a file a row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def contents(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, content) of the files below ``path`` whose names end in ``suffix``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select("path", "content")


def saved(files: DataFrame, path: str) -> int:
    """Write each row of ``files`` (name, content) to the folder ``path``; the number of files.

    A file is written under another name and then moved, so a task that is run again leaves whole files only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, folder = FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with store.open_output_stream(f"{folder}/_{name}") as out:
                    out.write(content.as_buffer())
                store.move(f"{folder}/_{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return sum(r.n for r in files.select("name", "content").mapInArrow(run, "n long").groupBy().sum("n").toDF("n").collect() if r.n)
