"""The operators' queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontam, divergence, filteraudit, langid, licences, lmscore, neardup, packing, quality, sharding, tokenfiles, topk
from .cluster import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int, which: int) -> Column:
    """Whether crc32(doc_id as text) leaves ``which``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == which


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"), fold(4, 2))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two-word shingles; the operator's own default is five."""
    return neardup.classes(_table(spark, sf_dir, "documents"), width=2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(3, 1))


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents that ``labels`` marks as good."""
    return lmscore.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").filter("quality = 1"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_language_id,
        op3_token_files,
        op4_license_scan,
        op5_exact_top_k,
        op6_near_duplicates,
        op7_decontamination,
        op8_quality,
        op9_rendezvous_sharding,
        op10_lm_score,
        op11_byte_bpe,
        op12_filter_audit,
        op13_source_divergence,
    )
}
TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i])) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.row <> q.row AND len(q.c) = len(v.c)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
ORACLES: dict[str, str] = {"op4_license_scan": licences.SCAN_SQL, "op5_exact_top_k": TOP_K_SQL, "op7_decontamination": decontam.REPORT_SQL, "op12_filter_audit": filteraudit.AUDIT_SQL, "op13_source_divergence": divergence.AUDIT_SQL}
