import corpus_pipeline
from pyspark.sql import functions as F

from pedalspark.llm import decontam, langid, neardup, packing, quality

from .fixtures import SF, documents, table
from .test_texts import brute_kept, brute_report


def test_each_stage_on_its_predecessor(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "near-dedup", "benchmark decontamination", "best-fit packing"]

    good = stage["quality classifier"](spark, docs, SF).cache()
    rejected = {r.doc_id for r in quality.scores(docs, labels, F.lit(False)).filter("predicted = 0").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - rejected
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    fine = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(rejected & bad) >= 0.9 * len(bad) and len(rejected & fine) <= 0.05 * len(fine)

    known = stage["language ID"](spark, good, SF).cache()
    assert known.columns == docs.columns and known.count() >= 0.98 * good.count()

    unique = stage["near-dedup"](spark, known, SF).cache()
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert {r.doc_id for r in unique.collect()} == {d for d, _ in brute_kept(rows)}

    clean = stage["benchmark decontamination"](spark, unique, SF).cache()
    rows, items = [(r.doc_id, r.text) for r in unique.collect()], [(r.item_id, r.text) for r in bench.collect()]
    assert {r.doc_id for r in clean.collect()} == {k[0] for k in brute_report(rows, items) if not k[-1]}

    packed = stage["best-fit packing"](spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r)[:5] for r in packed)


def test_odd_documents(spark):
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        docs = out.cache()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
    assert langid and neardup and decontam and packing and documents
