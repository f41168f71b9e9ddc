"""Language identification with a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, the maximum of each filter over the window
feeds a softmax. Since the input is a byte, embedding and filters fold into one table for each offset, so inference is
table lookups and sums. A text's probabilities are the mean over all of its windows, which overlap by the widest filter
less one, so that every byte run of the whole text is seen.

Training takes windows at hashed places of at most ``per_language`` different texts of each language, on the driver.

Defined cases: ``und`` and score 0 for null texts and those without a letter, or if no labelled text has a byte; null
languages are not learned; null and repeated doc_ids draw by their texts; repeated rows are learned once and predicted
alike; equal probabilities go to the language that stands first in the alphabet; a text of any length is cut into windows
block by block; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import stored
from .textbytes import text_slices, thrifty, utf8

WIDTHS, FILTERS, EMBED, WINDOW = (4, 3, 2), 16, 8, 256
PER_LANGUAGE, WINDOWS_A_TEXT, STEPS, BATCH = 600, 6, 1500, 64
#: Texts of all languages together that are collected for training.
MOST_TEXTS = 20_000


class ByteCnn:
    """Filters stand by descending width, so that those that reach offset j come first."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        n = FILTERS * len(WIDTHS)
        self.reach = [FILTERS * sum(w > j for w in WIDTHS) for j in range(WIDTHS[0])]
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (EMBED, r)).astype(np.float32) for r in self.reach]
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def tables(self) -> list[np.ndarray]:
        return [self.embed @ f for f in self.filters]

    def _slide(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        size = windows.shape[1] - WIDTHS[0] + 1
        acc = np.take(tables[0], windows[:, :size], axis=0)
        for j in range(1, WIDTHS[0]):
            acc[:, :, : self.reach[j]] += np.take(tables[j], windows[:, j : j + size], axis=0)
        return acc

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        out = [self._softmax(np.maximum(self._slide(windows[i : i + 64], tables).max(1) + self.bias, 0) @ self.out + self.out_bias) for i in range(0, len(windows), 64)]
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = 0.004, seed: int = 6) -> None:
        """Adam on the cross-entropy; only a filter's maximum over the window has a gradient."""
        rng = np.random.default_rng(seed)
        params = [self.embed, *self.filters, self.bias, self.out, self.out_bias]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        by_class = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(own, -(-BATCH // len(by_class))) for own in by_class if len(own)])
            x, y = windows[pick], labels[pick]
            acc = self._slide(x, self.tables())
            top = acc.argmax(1)  # [batch, filters]
            pooled = np.take_along_axis(acc, top[:, None, :], 1)[:, 0] + self.bias
            hidden = np.maximum(pooled, 0)
            error = self._softmax(hidden @ self.out + self.out_bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ self.out.T) * (pooled > 0)
            grads = [np.zeros_like(self.embed)]
            for j, f in enumerate(self.filters):
                r = self.reach[j]
                seen = np.take_along_axis(x, top[:, :r] + j, 1)
                grads.append(np.einsum("bfe,bf->ef", self.embed[seen], back[:, :r]))
                np.add.at(grads[0], seen, back[:, :r, None] * f.T[None])
            grads += [back.sum(0), hidden.T @ error, error.sum(0)]
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


#: Windows that are cut from the bytes at once.
WINDOW_BLOCK = 1024


def window_places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, text): windows first[i] to first[i + 1] - 1 are text i's; the text of each window."""
    stride = WINDOW - WIDTHS[0] + 1
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(1, -(-(n - WIDTHS[0] + 1) // stride)), 0)
    return np.concatenate(([0], np.cumsum(count))), np.repeat(np.arange(len(n), dtype=np.int32), count)


def windows_of(buf: np.ndarray, offsets: np.ndarray, first: np.ndarray, text: np.ndarray, a: int, b: int) -> np.ndarray:
    """uint8 [b - a, WINDOW]: windows ``a`` to ``b`` - 1, padded with zeros."""
    own = text[a:b]
    start = offsets[own] + (np.arange(a, a + len(own)) - first[own]) * (WINDOW - WIDTHS[0] + 1)
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[own + 1][:, None]
    return np.where(inside, buf[np.minimum(at, max(0, len(buf) - 1))] if len(buf) else 0, 0).astype(np.uint8)


def mean_probabilities(net: ByteCnn, tables: list[np.ndarray], buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """float64 [texts, classes]: the mean over each text's windows, zeros for empty texts."""
    first, text = window_places(offsets)
    total = np.zeros((len(offsets) - 1, len(net.classes)))
    for a in range(0, len(text), WINDOW_BLOCK):
        p = net.probabilities(windows_of(buf, offsets, first, text, a, a + WINDOW_BLOCK), tables)
        own = text[a : a + WINDOW_BLOCK]
        for c in range(p.shape[1]):
            total[own[0] : own[-1] + 1, c] += np.bincount(own - own[0], p[:, c], own[-1] - own[0] + 1)
    return total / np.maximum(np.diff(first), 1)[:, None]


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_TEXTS) -> list[tuple[str, list[str]]]:
    """(lang, pieces): windows at hashed places of at most ``per_language`` different texts of each language, collected.

    Texts are drawn by the smallest hashes of doc_id and text, the same ones at any partitioning; copies count once. All
    languages together have at most ``most`` texts, or one each.
    """
    key = F.xxhash64("doc_id", "text", F.lit(77))
    some = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("key", key)
    known = stored(some.select("lang", "key").distinct(), "keys")
    bound = min(per_language, max(1, most // max(1, known.select("lang").distinct().count())))
    # each task passes on at most ``bound`` rows a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    keys = F.broadcast(known.withColumn("r", rank).filter(F.col("r") <= bound).select("lang", "key"))
    place = lambda j: F.pmod(F.xxhash64("doc_id", F.lit(j)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))) + 1
    pieces = F.array(*(F.col("text").substr(place(j).cast("int"), F.lit(WINDOW)) for j in range(WINDOWS_A_TEXT)))
    rows = some.join(keys, ["lang", "key"]).groupBy("lang", "key").agg(F.min(pieces).alias("pieces")).collect()
    return sorted((r.lang, r.pieces) for r in rows)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> ByteCnn | None:
    """A network from (doc_id, text, lang) rows; None if no language has a text with a byte."""
    rows = sample(labelled, per_language)
    if not rows:
        return None
    classes = sorted({lang for lang, _ in rows})
    buf, offsets = utf8(pa.array([p for _, pieces in rows for p in pieces], pa.string()))
    first, text = window_places(offsets)
    windows = windows_of(buf, offsets, first, text, 0, len(text))
    labels = np.repeat(np.repeat([classes.index(lang) for lang, _ in rows], WINDOWS_A_TEXT), np.diff(first))
    net = ByteCnn(classes)
    net.train(windows, labels)
    return net


def _predicted(docs: DataFrame, net: ByteCnn | None, carry: list[str]) -> tuple[DataFrame, list[Column]]:
    """(table with lang_pred and score, the columns ``carry`` in it, which stand there under names of their own)."""
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(carry)]  # the text goes to the workers once
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(carry, names) if n != "text"]
    rows = docs.select(F.col("text").alias("text"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"), *own)
    kinds = dict(rows.dtypes)
    back = [F.col(n).alias(c) for c, n in zip(carry, names)]
    if net is None:
        return rows.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")), back

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            for part in text_slices(batch):
                mean = mean_probabilities(net, tables, *utf8(part.column(0)))
                letters = part.column(1).to_numpy(zero_copy_only=False)
                best = [net.classes[c] if ok else "und" for c, ok in zip(mean.argmax(1), letters)]
                score = pa.array(np.where(letters, np.clip(mean.max(1), 0, 1), 0.0))
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(best, pa.string()), score], [*names, "lang_pred", "score"])

    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", lang_pred string, score double"
    return rows.mapInArrow(thrifty(run), schema), back


def predict(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    df, back = _predicted(docs, net, ["doc_id"])
    return df.select(*back, "lang_pred", "score")


def spoken(docs: DataFrame, net: ByteCnn | None, least: float) -> DataFrame:
    """The rows of ``docs`` (text, ...) in a language that the network knows with a score of ``least`` or more."""
    df, back = _predicted(docs, net, docs.columns)
    return df.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*back)


def languages(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows of ``docs`` (doc_id, text, lang) that ``held_out`` spares."""
    held = F.coalesce(held_out, F.lit(False))
    net = fit(docs.filter(~held).select("doc_id", "text", "lang"))
    return predict(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")
