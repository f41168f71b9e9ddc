"""High-risk areas: labels, resampling, classifiers and their evaluation, on Spark ML."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percentiles, running_before
from ..storage import stored
from .clusters import STRIP, distances_between

SEED = 42


#: Rows for each task of a fit. A fit is hundreds of short jobs, so a small table must not be spread over many tasks.
ROWS = 20_000


def packed(df: DataFrame, name: str = "packed") -> DataFrame:
    """``df``, stored and read in as few partitions as hold ``ROWS`` rows each."""
    rows = stored(df, name)
    return rows.coalesce(max(1, -(-rows.count() // ROWS)))


def risk_label(df: DataFrame, count: str = "accidents", share: float = 0.85) -> DataFrame:
    """``df`` with label 1 where the count is above the percentile, interpolated linearly."""
    cut = percentiles(df, count, {"_c": share}).withColumn("_k", F.lit(1))
    return df.withColumn("_k", F.lit(1)).join(cut, "_k").withColumn("label", (F.col(count) > F.col("_c")).cast("int")).drop("_k", "_c")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) with weights n / (classes * n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(1))  # a row for each class
    return counts.withColumn("weight", F.sum("n").over(one) / (F.count("*").over(one) * F.col("n")))


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: the same rows whatever the partitions."""
    held = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < test * float(1 << 30)
    return df.filter(~held), df.filter(held)


def standardised(train: DataFrame, *others: DataFrame, features: list[str]) -> list[DataFrame]:
    """Each table with the vector ``features``, scaled by the first one's means and deviations."""
    steps = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="skip"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]).fit(train)
    return [steps.transform(df).drop("raw_features") for df in (train, *others)]


def smote(train: DataFrame, features: list[str], key: str, label: str = "label", k: int = 5, seed: int = SEED, kind: str = "smote") -> DataFrame:
    """``train`` (key, features, label) with made-up rows of label 1 until the classes are even; their key is null.

    ``kind``: ``smote`` takes all rows of the class alike, ``borderline`` those that have mostly other neighbours,
    ``adasyn`` takes them in proportion to their other neighbours, ``smoteenn`` removes rows afterwards that most of
    their neighbours contradict. Neighbours come from blocks of bounded size; random numbers are hashes.
    """
    rows = stored(train.select(key, *features, label), "train")
    n = {r[label]: r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    missing = n.get(0, 0) - n.get(1, 0)
    if missing <= 0 or n.get(1, 0) < 2:
        return rows
    minority = rows.filter(F.col(label) == 1)
    chosen = minority.withColumn("part", F.lit(1.0))
    if kind in ("borderline", "adasyn"):
        around = neighbours(minority, rows, features, key, k)
        other = around.join(rows.select(F.col(key).alias("_o"), (1 - F.col(label)).alias("foe")), "_o").groupBy(key).agg(F.avg("foe").alias("foe"))
        weigh = F.col("foe") if kind == "adasyn" else ((F.col("foe") >= 0.5) & (F.col("foe") < 1)).cast("double")
        weighed = stored(minority.join(other, key).withColumn("part", weigh).filter("part > 0").drop("foe"), "weighed")
        chosen = chosen if weighed.isEmpty() else weighed
    total = chosen.agg(F.sum("part")).first()[0]
    # how many rows each makes: its share, rounded up or down by a hash
    share = F.col("part") * (missing / total)
    chance = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1 << 30)) / float(1 << 30)
    makers = chosen.withColumn("times", (F.floor(share) + (chance(key, F.lit(-1)) < share - F.floor(share)).cast("int")).cast("int")).filter("times > 0")
    made = makers.withColumn("t", F.explode(F.sequence(F.lit(1), F.col("times"))))
    near = neighbours(minority, minority, features, key, k).groupBy(key).agg(F.sort_array(F.collect_list("_o")).alias("_near"))
    made = made.join(near, key).withColumn("_o", F.col("_near")[F.floor(chance(key, "t", F.lit(1)) * F.size("_near")).cast("int")])
    partner = minority.select(F.col(key).alias("_o"), *(F.col(c).alias(f"_{c}") for c in features))
    at = chance(key, "t", F.lit(2))
    new = made.join(partner, "_o").select(F.lit(None).cast(dict(rows.dtypes)[key]).alias(key), *((F.col(c) + at * (F.col(f"_{c}") - F.col(c))).alias(c) for c in features), F.lit(1).cast(dict(rows.dtypes)[label]).alias(label))
    out = rows.unionByName(new)
    if kind != "smoteenn":
        return out
    out = stored(out.withColumn("_id", F.monotonically_increasing_id()), "resampled")
    votes = neighbours(out, out, features, "_id", 3).join(out.select(F.col("_id").alias("_o"), F.col(label).alias("_l")), "_o").groupBy("_id").agg(F.avg("_l").alias("v"))
    return out.join(votes, "_id").filter(F.abs(F.col("v") - F.col(label)) < 0.5).drop("_id", "v")


def neighbours(left: DataFrame, right: DataFrame, features: list[str], key: str, k: int, block: int = 4096) -> DataFrame:
    """(key, _o, d): the ``k`` nearest other rows of ``right`` for each of ``left``, compared in blocks."""
    blocks = max(1, -(-right.count() // block))
    kind = dict(left.dtypes)[key]
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    mine = left.select(key, *features, F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_i")).withColumn("_j", each)
    theirs = right.select(F.col(key).alias("_o"), *features, F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_j")).withColumn("_i", each)
    theirs = theirs.toDF(*theirs.columns)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: a[key].head(0), "_o": a[key].head(0), "d": pd.Series([], dtype=float)})
        x, y = a[features].to_numpy(float), b[features].to_numpy(float)
        own, other, square = a[key].to_numpy(), b["_o"].to_numpy(), (y * y).sum(1)
        rows, kept = max(1, STRIP // len(b)), []
        for i in range(0, len(a), rows):
            d = distances_between(x[i : i + rows], y, square)
            d[own[i : i + rows, None] == other[None]] = np.inf
            few = np.argsort(d, 1, kind="stable")[:, :k]
            kept.append((np.repeat(own[i : i + rows], few.shape[1]), other[few.ravel()], np.take_along_axis(d, few, 1).ravel()))
        out = pd.DataFrame(dict(zip((key, "_o", "d"), map(np.concatenate, zip(*kept)))))
        return out[np.isfinite(out.d)]

    found = mine.groupBy("_i", "_j").cogroup(theirs.groupBy("_i", "_j")).applyInPandas(run, f"`{key}` {kind}, `_o` {kind}, d double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("d", "_o"))).filter(F.col("r") <= k).drop("r")


def forest(train: DataFrame, weight: str | None = None, trees: int = 100, features: str = "sqrt"):
    model = RandomForestClassifier(numTrees=trees, featureSubsetStrategy=features, seed=SEED, labelCol="label", featuresCol="features")
    return (model.setWeightCol(weight) if weight else model).fit(train)


def stratified(df: DataFrame, key: str, folds: int = 5, label: str = "label", seed: int = SEED) -> DataFrame:
    """``df`` with ``fold``: the rows of each class in the order of their hashes, dealt out in turn, so all folds have the classes' shares.

    ``key`` names rows; made-up rows without one are told apart by their features.
    """
    rows = stored(df.withColumn("_h", F.xxhash64(F.lit(seed), key, *(c for c, kind in df.dtypes if kind == "double"))).withColumns({"_n": F.monotonically_increasing_id(), "_one": F.lit(1)}), "rows")
    return running_before(rows, [label], ["_h", "_n"], "_one", "_b").withColumn("fold", (F.col("_b") % folds).cast("int")).drop("_h", "_n", "_one", "_b")


#: Grids of the three models; C is the inverse of the penalty's weight, as in other libraries.
GRIDS = {"logreg": {"C": [0.01, 0.1, 1, 10, 100]}, "forest": {"trees": [10, 50, 100, 200], "features": ["sqrt", "log2"]}, "svm": {"C": [0.01, 0.1, 1, 10], "kernel": ["linear", "rbf", "poly"]}}


class Searched:
    """The best of a grid: ``transform`` maps tables with ``features`` as the model needs them."""

    def __init__(self, model, score: float, choice: dict, kernel: Nystroem | None = None):
        self.model, self.score, self.choice, self.kernel = model, score, choice, kernel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.kernel.transform(df) if self.kernel else df)


def grid_search(train: DataFrame, model: str, folds: int = 5, grid: dict | None = None, weight: str | None = None, landmarks: int = 100, iterations: int = 100) -> Searched:
    """The best of a grid by area under the ROC curve: ``logreg``, ``forest`` or ``svm`` with linear, radial or cubic kernels.

    A ``fold`` column of ``train`` deals out its rows (``stratified``); without one the rows are dealt by chance. Kernels
    work on ``landmarks`` rows (``Nystroem``), so a model costs the same whatever the number of rows.
    """
    if model not in GRIDS:
        raise ValueError(model)
    grid = grid or GRIDS[model]
    train = packed(train, "train").cache()
    n = train.count()
    penalties = [1.0 / (c * max(1, n)) for c in grid.get("C", [])]
    weigh = lambda est: est.setWeightCol(weight) if weight else est
    by_fold = {"foldCol": "fold"} if "fold" in train.columns else {}

    def best(est, params, df: DataFrame):
        found = CrossValidator(estimator=weigh(est), estimatorParamMaps=params, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=folds, seed=SEED, parallelism=4, **by_fold).fit(df)
        k = max(range(len(params)), key=lambda i: found.avgMetrics[i])
        return found.bestModel, found.avgMetrics[k], {p.name: v for p, v in params[k].items()}

    try:
        if model == "logreg":
            est = LogisticRegression(labelCol="label")
            return Searched(*best(est, ParamGridBuilder().addGrid(est.regParam, penalties).build(), train))
        if model == "forest":
            est = RandomForestClassifier(labelCol="label", seed=SEED)
            return Searched(*best(est, ParamGridBuilder().addGrid(est.numTrees, grid["trees"]).addGrid(est.featureSubsetStrategy, grid["features"]).build(), train))
        results = []
        for name in grid["kernel"]:
            kernel = Nystroem(train, name, landmarks) if name != "linear" else None
            est = LinearSVC(labelCol="label", featuresCol="mapped" if kernel else "features", maxIter=iterations, standardization=kernel is None)
            df = kernel.transform(train).cache() if kernel else train
            fitted, score, choice = best(est, ParamGridBuilder().addGrid(est.regParam, penalties).build(), df)
            if kernel:
                df.unpersist()
            results.append(Searched(fitted, score, choice | {"kernel": name}, kernel))
        return max(results, key=lambda r: r.score)
    finally:
        train.unpersist()


class Nystroem:
    """Vectors ``mapped`` whose inner products approximate a kernel of ``features``, by landmarks (Williams and Seeger, 2001).

    The landmarks are the ``m`` different rows of the smallest hashes: a bounded sample, whatever the table's size. ``rbf``
    is exp(-gamma |x - y|^2), ``poly`` is (gamma x y)^3, with gamma one over the features' number times their variance.
    """

    def __init__(self, train: DataFrame, kind: str, m: int = 100):
        if kind not in ("rbf", "poly"):
            raise ValueError(kind)
        rows = train.select(vector_to_array("features").alias("x"))
        drawn = rows.distinct().orderBy(F.xxhash64(F.lit(SEED), "x"), "x").limit(m).collect()
        one = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v").alias("v")).first()
        self.kind, self.points = kind, np.array([r.x for r in drawn], float)
        self.gamma = 1.0 / (self.points.shape[1] * one.v) if len(drawn) and one.v else 1.0
        values, vectors = np.linalg.eigh(self.kernel(self.points)) if len(drawn) else (np.zeros(0), np.zeros((0, 0)))
        some = values > 1e-10 * max(1.0, values.max(initial=0.0))
        self.root = vectors[:, some] / np.sqrt(values[some])

    def kernel(self, x: np.ndarray) -> np.ndarray:
        inner = x @ self.points.T
        if self.kind == "poly":
            return (self.gamma * inner) ** 3
        return np.exp(-self.gamma * np.maximum(0, (x * x).sum(1)[:, None] + (self.points**2).sum(1)[None] - 2 * inner))

    def transform(self, df: DataFrame) -> DataFrame:
        own = self

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(own.kernel(np.stack(x.to_numpy())) @ own.root)) if len(x) else pd.Series([], dtype=object)

        return df.withColumn("mapped", array_to_vector(mapped(vector_to_array("features"))))


def searched_areas(train: DataFrame, test: DataFrame, features: list[str], key: str, samplers: tuple[str, ...] = ("smote", "adasyn", "borderline", "smoteenn"), models: tuple[str, ...] = ("logreg", "forest", "svm"), folds: int = 5, grids: dict | None = None, iterations: int = 100) -> DataFrame:
    """(sampler, model, choice, cv_area, roc_auc, pr_auc): every model's best of its grid after every sampler, on the rows held out."""
    spark, out = train.sparkSession, []
    for sampler in samplers:
        more = smote(train, features, key, kind=sampler)
        scaled, held = standardised(more, test, features=features)
        dealt = stored(stratified(scaled, key, folds), "dealt")
        for model in models:
            found = grid_search(dealt, model, folds, (grids or {}).get(model), iterations=iterations)
            got = areas(found.transform(held))
            out.append((sampler, model, str(found.choice), float(found.score), float(got["roc_auc"]), float(got["pr_auc"])))
    return spark.createDataFrame(out, "sampler string, model string, choice string, cv_area double, roc_auc double, pr_auc double")


def areas(scored: DataFrame) -> dict[str, float]:
    return {name: BinaryClassificationEvaluator(labelCol="label", metricName=metric).evaluate(scored) for name, metric in (("roc_auc", "areaUnderROC"), ("pr_auc", "areaUnderPR"))}


def with_score(predicted: DataFrame) -> DataFrame:
    return predicted.withColumn("score", vector_to_array("probability")[1])


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) from the confusion counts."""
    c = confusion(df, label, prediction)
    own, said, hit = F.sum(F.when(F.col("label") == F.col("k"), F.col("n"))), F.sum(F.when(F.col("prediction") == F.col("k"), F.col("n"))), F.sum(F.when((F.col("label") == F.col("k")) & (F.col("prediction") == F.col("k")), F.col("n")))
    rows = c.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).groupBy("k").agg(F.coalesce(own, F.lit(0)).alias("support"), F.coalesce(said, F.lit(0)).alias("said"), F.coalesce(hit, F.lit(0)).alias("hit"))
    precision, recall = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select(F.col("k").alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def roc_points(df: DataFrame, score: str = "score", label: str = "label", bins: int = 1000) -> DataFrame:
    """(threshold, tpr, fpr): a point for each of at most ``bins`` score bins."""
    counts = df.groupBy((F.floor(F.col(score) * bins) / bins).alias("threshold")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(F.lit(1))
    return counts.select("threshold", (F.sum("p").over(down) / F.sum("p").over(all_)).alias("tpr"), (F.sum("q").over(down) / F.sum("q").over(all_)).alias("fpr"))
