"""Stratified folds, kernels on landmarks and the search over grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedalspark.operators import risk


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes that no line parts: a disc and a ring around it."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        label = int(i % 4 == 0)
        r, a = (rng.uniform(0, 1) if label else rng.uniform(2, 3)), rng.uniform(0, 2 * np.pi)
        rows.append((f"h{i}", float(r * np.cos(a)), float(r * np.sin(a)), label))
    df = spark.createDataFrame(rows, "hex string, a double, b double, label int").coalesce(1)
    return risk.standardised(df, features=["a", "b"])[0].cache()


def test_folds_have_the_shares_of_the_classes(rings):
    for fold, label, n in risk.stratified(rings, "hex", 5).groupBy("fold", "label").count().collect():
        assert n == (8 if label else 24) and 0 <= fold < 5
    again = risk.stratified(rings.repartition(7), "hex", 5)
    assert {(r.hex, r.fold) for r in again.collect()} == {(r.hex, r.fold) for r in risk.stratified(rings, "hex", 5).collect()}


@pytest.mark.parametrize("kind", ["rbf", "poly"])
def test_kernels_are_exact_with_all_rows_as_landmarks(rings, kind):
    rows = [r for r in risk.Nystroem(rings, kind, 1000).transform(rings).select("features", "mapped").collect()]
    x, z = (np.array([r[k].toArray() for r in rows]) for k in (0, 1))
    gamma = 1 / (2 * x.var())
    exact = (gamma * x @ x.T) ** 3 if kind == "poly" else np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(z @ z.T, exact, atol=1e-5)


def test_a_kernel_wins_where_no_line_parts_the_classes(rings):
    grid = {"C": [10], "kernel": ["linear", "rbf"]}
    found = risk.grid_search(risk.stratified(rings, "hex", 2).coalesce(1), "svm", 2, grid, landmarks=40, iterations=15)
    assert found.choice["kernel"] == "rbf" and found.score > 0.98
    assert risk.areas(found.transform(rings))["roc_auc"] > 0.98
    with pytest.raises(ValueError):
        risk.grid_search(rings, "other")


def test_areas_by_sampler_and_model(rings):
    df = rings.select("hex", "a", "b", "label")
    train, test = risk.split(df, "hex")
    grids = {"logreg": {"C": [1]}, "svm": {"C": [1], "kernel": ["rbf"]}}
    rows = risk.searched_areas(train, test, ["a", "b"], "hex", ("smote",), ("logreg", "svm"), 2, grids, 15).collect()
    assert [(r.sampler, r.model) for r in rows] == [("smote", "logreg"), ("smote", "svm")]
    assert all(0 <= x <= 1 for r in rows for x in (r.cv_area, r.roc_auc, r.pr_auc)) and rows[1].roc_auc > rows[0].roc_auc


def test_fits_of_small_tables_stay_in_few_tasks(rings, monkeypatch):
    """A fit is hundreds of jobs: spread over 40 tasks each, 160 rows take minutes."""
    seen = []

    class Watched(risk.CrossValidator):
        def fit(self, df, params=None):
            seen.append(df.rdd.getNumPartitions())
            return super().fit(df, params)

    monkeypatch.setattr(risk, "CrossValidator", Watched)
    risk.grid_search(risk.stratified(rings, "hex", 2).repartition(40), "svm", 2, {"C": [1], "kernel": ["linear", "rbf"]}, landmarks=20, iterations=5)
    assert seen == [1, 1]
