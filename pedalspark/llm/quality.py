"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of every whole text are taken once and stored; labels join them, never the texts. Normal equations are
sums of outer products, added up by task and then by row of the matrix. Calibration pools adjacent violators over a
fixed number of score bins. Both take all labelled rows; no sample is drawn.

Defined cases: null and empty texts have statistics of their own (zeros) and a score; labels that are null or without a
document are left out, repeated labels count as often as they stand; without labels of both classes every score is the
share of ones, 0.5 if there are none; repeated rows have equal scores, and equal scores are no case of their own, as
nothing is ranked; a text of any length is counted in pieces; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import stored
from .textbytes import PIECE, mix, spans, text_slices, thrifty, utf8, word_hashes

FEATURES, RIDGE, SUM_TASKS, BINS, SEED = 384, 1.0, 32, 400, 11

_CLASSES = np.zeros(256, np.uint8)  # 0 other ASCII, then:
for _number, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" ", b"\n", b".,", b"!?", b"|", b"#$%&*", b"@:/=_<>{}[]\\", range(128, 256)), 1):
    _CLASSES[list(_bytes)] = _number
N_STATS = 12 + 9


def statistics(column: pa.Array) -> np.ndarray:
    """float32 [texts, N_STATS]: shares of byte classes, sizes, and repetition among words, word pairs and lines."""
    buf, offsets = utf8(column)
    n = np.diff(offsets)
    out, counts = np.zeros((len(n), N_STATS), np.float32), np.zeros((len(n), 12), np.int64)
    for a in range(0, len(buf), PIECE):
        part = buf[a : a + PIECE]
        i, j = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, a + len(part)))
        cells = np.repeat(np.arange(0, 12 * (j - i), 12, dtype=np.int32), np.diff(np.clip(offsets[i : j + 1], a, a + len(part))))
        counts[i:j] += np.bincount(cells + _CLASSES[part], minlength=12 * (j - i)).reshape(-1, 12)
    out[:, :12] = counts / np.maximum(n, 1)[:, None]
    starts, ends, first = spans(buf, offsets)
    words = word_hashes(buf, starts, ends, lower=True)
    lengths = (ends - starts).astype(np.float64)
    line = np.ones(256, bool)
    line[10] = False
    ls, le, lf = spans(buf, offsets, line)
    lines = word_hashes(buf, ls, le)
    two = mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
    for i in range(len(n)):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        k, own = b - a, lengths[a:b]
        times = np.unique(words[a:b], return_counts=True)[1]
        pairs = np.unique(two[a : b - 1], return_counts=True)[1] if k > 1 else times
        same = np.unique(lines[lf[i] : lf[i + 1]], return_counts=True)[1]
        out[i, 12:] = (np.log1p(k), own.mean(), own.std(), len(times) / k, times.max() / k, len(pairs) / max(1, k - 1), pairs.max() / k, len(same) / same.sum(), np.log1p(same.sum()))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of N_STATS floats) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                x = statistics(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATS, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id long, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_STATS)


class Fourier:
    """cos(xW + b) of standardised statistics: its inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, width: float = 4.0):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, 1 / np.where(deviation > 1e-9, deviation, 1)
        self.w = rng.normal(size=(N_STATS, FEATURES)) / width
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        return np.hstack((np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))))


def normal_equations(train: DataFrame, features: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """(Z'Z, Z'y) over ``train`` (stats, y): each task sends its rows of the sum, and each row is added up by itself."""
    d = FEATURES + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            z = features(_matrix(batch.column(0)))
            total += z.T @ np.hstack((z, batch.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(table: pa.Table) -> pa.Table:  # SUM_TASKS rows at most
        total = sum(np.frombuffer(x.as_py()) for x in table.column("row"))
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())})

    sums = train.select("stats", "y").repartition(SUM_TASKS).mapInArrow(thrifty(run), "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary").collect()
    both = np.vstack([np.frombuffer(r.row) for r in sorted(sums, key=lambda r: r.i)])
    return both[:, :-1], both[:, -1]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of least squares to bins of mean x and mean y: pools adjacent violators."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def scores(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``. Labels of rows where ``held_out`` (of doc_id) holds are not used."""
    rows = stored(measured(docs), "statistics")
    held = F.coalesce(held_out, F.lit(False))
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter(F.col("y").isin(0.0, 1.0) & ~held)
    train = stored(rows.join(known, "doc_id").select("doc_id", "stats", "y"), "labelled")
    moments = [f(F.col("stats")[i]).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(N_STATS)]
    total = train.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *moments).first()
    share = total.y if total.n else 0.5
    if share in (0.0, 1.0) or not total.n:
        out = rows.withColumn("score", F.lit(float(share)))
    else:
        features = Fourier(*(np.array([total[f"{n}{i}"] for i in range(N_STATS)]) for n in "ms"))
        fit, tune = (train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0), train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0))
        gram, moment = normal_equations(fit, features)
        beta = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), moment)

        def scored(df: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(0, batch.num_rows, 4096):
                        part = batch.slice(i, 4096)
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(of(features(_matrix(part.column(1))) @ beta))], ["doc_id", "y", "score"])

            return df.select("doc_id", "stats", "y").mapInArrow(thrifty(run), "doc_id long, y double, score double")

        binned = scored(tune, lambda r: r).withColumn("bin", F.floor(F.least(F.greatest(F.col("score"), F.lit(-0.5)), F.lit(1.5)) * (BINS // 2)))
        bins = sorted((r.x, r.y, r.n) for r in binned.groupBy("bin").agg(F.avg("score").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).collect())
        x, y = isotonic(*map(np.array, zip(*bins))) if bins else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

        def calibrated(r: np.ndarray) -> np.ndarray:
            """Beyond a step's plateau the raw score still orders documents, by a hair."""
            fitted = np.interp(r, x, y) if len(x) > 1 else np.full(len(r), y[0])
            return np.clip(0.999 * fitted + 0.001 / (1 + np.exp(-4 * (r - 0.5))), 0, 1)

        out = scored(rows.withColumn("y", F.lit(None).cast("double")), calibrated)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
