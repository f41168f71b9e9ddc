"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

The plan depends on the histogram of piece lengths alone (at most ``capacity`` entries, whatever the corpus), so it is
made once, in runs of equal bins, and each piece finds its place from its rank among the pieces of its length. Ranks are
a count in the piece's own partition plus the sum over earlier partitions: no group is gathered, and a hot length is no
different from any other.

Defined cases: a null text is an empty one; an empty text is one piece that holds the end id alone; repeated rows are
documents of their own; a null doc_id is kept; pieces of equal length are placed in the order of their tasks and rows;
a text of any length is encoded in parts and cut into pieces; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import stored
from .textbytes import text_slices, thrifty
from .tokens import default_path, word_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, items of that length a bin, offset in the bin), by length and rank.

    Lengths above a third of the capacity pair at most twice a bin: the longest with the longest that fits beside it.
    Each shorter length, longest first, goes to the bins with the tightest gap that holds it, as many as the gap takes.
    Every step uses up a length or a run of equal bins, so the number of runs is bounded by the capacity, not the rows.
    """
    left = {k: n for k, n in histogram.items() if n}
    ranks: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # gap -> [(first bin, bins, filled)]
    bins = 0

    def put(length: int, first_bin: int, n_bins: int, each: int, offset: int) -> None:
        runs.append((length, ranks[length], first_bin, each, offset))
        ranks[length] += n_bins * each
        left[length] -= n_bins * each

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for at, k in enumerate(large):
        partners = (m for m in large[at:] if m + k <= capacity)
        while left[k]:
            m = next((m for m in partners if left[m]), None)
            if m is None:
                n, filled = left[k], k
                put(k, bins, n, 1, 0)
            elif m == k:
                n, filled = left[k] // 2, 2 * k
                if n == 0:
                    continue
                put(k, bins, n, 2, 0)
            else:
                n, filled = min(left[k], left[m]), k + m
                put(k, bins, n, 1, 0)
                put(m, bins, n, 1, k)
            if filled < capacity:
                gaps[capacity - filled].append((bins, n, filled))
            bins += n
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[k]:
            gap = min((g for g in gaps if g >= k), default=None)
            if gap is None:
                each = capacity // k
                n = -(-left[k] // each)
                gaps[capacity].append((bins, n, 0))
                bins, gap = bins + n, capacity
            first, n, filled = gaps[gap].pop()
            each = min(gap // k, left[k])
            used = min(n, left[k] // each)
            put(k, first, used, each, filled)
            if used < n:
                gaps[gap].append((first + used, n - used, filled))
            if not gaps[gap]:
                del gaps[gap]
            if rest := gap - each * k:
                gaps[rest].append((first, used, filled + each * k))
    return sorted(runs)


def token_pieces(batches: Iterable[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document with their rank among the pieces of their length in this task."""
    from pyspark import TaskContext

    part, seen, bpe = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), word_bpe(path)
    for batch in batches:
        for own in text_slices(batch):
            ids, at = bpe.encode(own.column(1), end_id)
            n = np.diff(at)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            data, first = memoryview(ids).cast("B"), 4 * (at[:-1][doc] + start)
            crc = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
            within = np.arange(len(ordered)) - np.repeat(new, np.diff(np.append(new, len(ordered))))
            local = np.empty(len(length), np.int64)
            local[order] = seen[ordered] + within
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [own.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (length, part, local, ...) with sequence_id and offset. ``pieces`` must be a stored table: it is read more than once."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    runs = np.array(plan(histogram, capacity) or np.zeros((0, 5)), np.int64)
    shift = np.int64(1 << 44)  # more rows of one length than any table has
    keys = runs[:, 0] * shift + runs[:, 1] if len(runs) else np.zeros(0, np.int64)
    kept = [c for c in pieces.columns if c not in ("part", "local")]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = table["length"].to_numpy(), table.pop("rank").to_numpy()
            run = runs[np.searchsorted(keys, length * shift + rank, "right") - 1]
            within = rank - run[:, 1]
            each = np.maximum(run[:, 3], 1)
            table["sequence_id"] = pa.array(run[:, 2] + within // each)
            table["offset"] = pa.array(run[:, 4] + within % each * length)
            yield pa.RecordBatch.from_pydict(table)

    ranked = pieces.join(earlier, ["part", "length"]).select(*kept, (F.col("local") + F.col("earlier")).alias("rank"))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.select(*kept).dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(thrifty(find), schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text): its ids' range, their CRC and its place in a sequence.

    ``path``: a tokenizer file that every executor has. Only documents longer than ``capacity`` are cut.
    """
    path = path or default_path()
    cut = docs.select("doc_id", "text").mapInArrow(thrifty(lambda b: token_pieces(b, path, capacity, end_id)), PIECES)
    return place(stored(cut, "pieces"), capacity).select(*(x.split()[0] for x in PLACED.split(", ")))
