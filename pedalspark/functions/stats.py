"""Distributions and test statistics; per-row or per-table results are small, the sums behind them are Spark's."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_p(statistic: float, df: int) -> float:
    return gamma_q(df / 2, statistic / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        before = h
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            h *= c * d
        if abs(h - before) < 1e-15 * abs(h):
            break
    return front * h


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """(W, p) by Royston's approximation, for 4 to 5000 values: a sample that the caller bounds."""
    x = sorted(values)
    n = len(x)
    if not 4 <= n <= 5000 or x[0] == x[-1]:
        raise ValueError("between 4 and 5000 values that are not all equal")
    m = [normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    square, u = sum(v * v for v in m), 1 / math.sqrt(n)
    poly = lambda c: sum(k * u**i for i, k in enumerate(c))
    last = poly([m[-1] / math.sqrt(square), 0.221157, -0.147981, -2.07119, 4.434685, -2.706056])
    a = [0.0] * n
    a[-1], a[0] = last, -last
    if n > 5:
        second = poly([m[-2] / math.sqrt(square), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633])
        a[-2], a[1] = second, -second
        phi, inner = (square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2), range(2, n - 2)
    else:
        phi, inner = (square - 2 * m[-1] ** 2) / (1 - 2 * last**2), range(1, n - 1)
    for i in inner:
        a[i] = m[i] / math.sqrt(phi)
    mean = sum(x) / n
    w = min(1.0, sum(k * v for k, v in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu, sigma = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        z = (-math.log(g - math.log(max(1e-300, 1 - w))) - mu) / sigma
    else:
        k = math.log(n)
        mu, sigma = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3, math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
        z = (math.log(max(1e-300, 1 - w)) - mu) / sigma
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def chi2_uniform(counts: DataFrame, n: str = "n") -> DataFrame:
    """statistic and df of counts against a uniform distribution."""
    total = counts.agg(F.sum(n).alias("s"), F.sum(F.col(n).cast("double") * F.col(n)).alias("q"), F.count("*").alias("k"))
    return total.select((F.col("k") * F.col("q") / F.col("s") - F.col("s")).alias("statistic"), (F.col("k") - 1).alias("df"))


def chi2_pairwise(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The same for each pair of categories; there are as many rows as categories, a handful."""
    a = counts.select(F.col(key).alias("a"), F.col(n).alias("n_a"), F.lit(1).alias("one"))
    b = counts.select(F.col(key).alias("b"), F.col(n).alias("n_b"), F.lit(1).alias("one"))
    half = (F.col("n_a") + F.col("n_b")) / 2.0
    return a.join(b, "one").filter("a < b").select("a", "b", (((F.col("n_a") - half) * (F.col("n_a") - half) + (F.col("n_b") - half) * (F.col("n_b") - half)) / half).alias("statistic"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n): bins of equal width from 0; values equal to ``high`` count in the last one, others outside are left out."""
    x = F.col(column)
    bin_ = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter((x >= low) & (x <= high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of values, null being one."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def shares(df: DataFrame, column: str, n: str = "n") -> DataFrame:
    """value counts with ``share`` in percent; one row per value passes the window."""
    counts = df.groupBy(column).agg(F.count("*").alias(n))
    return counts.withColumn("share", 100.0 * F.col(n) / F.sum(n).over(Window.partitionBy(F.lit(1))))


def running_before(df: DataFrame, keys: list[str], order: list[str], n: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``n`` over the rows of the same keys that stand before in the order, which has no ties.

    Each range of the order counts by itself and adds the totals of earlier ranges, so no task sees all rows.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(ranges, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*keys or [F.lit(1)]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = dealt.groupBy(*keys, "_p").agg(F.sum(n).alias("_t")).select(*keys, "_p", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t"))
    own = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_o", F.coalesce(F.sum(n).over(own), F.lit(0))).join(totals, [*keys, "_p"]).withColumn(out, F.col("_o") + F.col("_t")).drop("_o", "_t", "_p")


def percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with the percentiles asked for by name, interpolated linearly. Values are found by their rank, not gathered."""
    counts = df.select(F.col(column).cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias("_n"))
    ranked = running_before(counts, [], ["_v"], "_n", "_b")
    ranked = stored(ranked, "ranked")
    total = ranked.agg(F.sum("_n")).first()[0] or 0
    at = lambda k: F.max(F.when((F.col("_b") <= k) & (F.lit(k) < F.col("_b") + F.col("_n")), F.col("_v")))

    def value(share: float) -> Column:
        place = max(0, total - 1) * share
        low = math.floor(place)
        return at(low) + (at(math.ceil(place)) - at(low)) * (place - low)

    return ranked.agg(*(value(share).alias(name) for name, share in shares.items()))


def describe(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    whole = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).withColumn("_k", F.lit(1))
    parts = percentiles(df, column, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumn("_k", F.lit(1))
    return whole.join(parts, "_k").select("n", "mean", "std", "min", "p25", "p50", "p75", "max")


def mid_ranks(df: DataFrame, column: str, out: str, by: str | None = None) -> DataFrame:
    """``df`` with the mean rank of equal values. Counts of distinct values are ranked, not rows, and by ranges."""
    keys = [by] if by else []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    ranks = running_before(counts, keys, [column], "_n", "_b").withColumn(out, F.col("_b") + (F.col("_n") + 1) / 2).drop("_n", "_b")
    return df.join(ranks, [*keys, column], "left")


def spearman(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """n and rho of the rows where both are given, whole or by group."""
    keys = [by] if by else []
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = mid_ranks(mid_ranks(rows, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"), F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided, by Student's t with n - 2 degrees of freedom."""
    return 0.0 if abs(rho) >= 1 else t_p(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def clean_lanes(text: Column) -> Column:
    """The numbers in a text, joined by " or "; the text itself if it has none."""
    numbers = F.regexp_extract_all(text, F.lit("(\\d+)"), 1)
    return F.when(F.size(numbers) > 0, F.array_join(numbers, " or ")).otherwise(text)


def clean_speed(text: Column) -> Column:
    numbers = F.regexp_extract_all(text, F.lit("(\\d+)"), 1)
    return F.when(text.contains("IT:urban"), 50).otherwise(F.coalesce(F.array_max(F.transform(numbers, lambda s: s.cast("int"))), F.lit(50)))


def mean_of_numbers(text: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(text, F.lit("(\\d+)"), 1), lambda s: s.cast("double"))
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b) / F.size(numbers))
