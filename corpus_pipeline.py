"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it again as the next stage's ``docs``. All stages but the last return the columns of ``docs``.

Defined cases: a null or empty text is scored like any other by the quality stage and rejected by the language stage, as
it has no letters; null doc_ids are kept as documents of their own, but share the quality stage's decision, as rows of
one doc_id do; repeated rows are near duplicates, so one stays; ties among near duplicates go to the smallest doc_id and
then the smallest digest; texts of any length are read whole; further columns are carried along, whatever their names;
an empty table passes every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalspark.llm import decontam, langid, neardup, packing, quality
from pedalspark.llm.cluster import prepare, stored

#: Texts in which no learned language has at least this mean probability are rejected.
LEAST_LANGUAGE = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, predicts to be good."""
    good = quality.scores(docs, _table(spark, sf_dir, "labels"), F.lit(False)).filter("predicted = 1").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_id"]), "left_semi")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the network knows."""
    prepare(spark)
    return langid.spoken(docs, langid.fit(docs), LEAST_LANGUAGE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    prepare(spark)
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontam.cleaned(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training and tokenization can't be said in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None
