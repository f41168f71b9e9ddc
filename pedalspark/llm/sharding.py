"""Rendezvous hashing of stable record keys over weighted shards.

A row goes to the shard with the lowest ``-ln(u) / weight``, where u comes from a hash of the key and the shard alone.
One more shard takes rows only into itself, and no table of rows or shards is kept.

Defined cases: a null text has no bytes (size 16, CRC 0); a null doc_id is one more key; repeated rows go to one shard
under slots of their own; equal costs go to the lower shard; a text of any length is only measured; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import stored

OVERHEAD = 16


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of ``key`` as an int; shards with a weight of 0 get nothing, ties go to the lower number."""
    if not any(w > 0 for w in weights):
        raise ValueError("a shard needs a weight above 0")

    def cost(j: int) -> Column:
        u = (F.pmod(F.xxhash64(key, F.lit(j)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.ln(u) / F.lit(float(weights[j]))).alias("cost"), F.lit(j).alias("shard"))

    return F.array_min(F.array(*(cost(j) for j in range(len(weights)) if weights[j] > 0)))["shard"]


def with_slots(df: DataFrame, group: str) -> DataFrame:
    """``df`` with a ``slot`` that counts the rows of each group from 0 without a gap.

    A row's slot is its number in its own part of the stored table plus the rows of earlier parts: groups are split over
    all tasks, so a hot one is no larger than the parts are.
    """
    held = stored(df.withColumn("part", F.spark_partition_id()), "shards")
    counts = held.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    own = Window.partitionBy(group, "part").orderBy(*(c for c in df.columns if c != group))
    numbered = held.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(earlier, [group, "part"]).withColumn("slot", F.col("own") + F.col("earlier")).drop("own", "earlier", "part")


def shards(docs: DataFrame, n: int = 40, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard if one more of mean weight is added)."""
    weights = weights or [1.0] * n
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + OVERHEAD).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
    )
    return with_slots(rows, "shard").select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
