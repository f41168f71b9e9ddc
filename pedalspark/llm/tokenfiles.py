"""Token ids in compressed binary blocks: Re-Pair grammars with expansion lengths, for random access.

File format. A folder of Parquet files, one for each shard; shards follow one another in ascending doc_id order. A row
is a block of whole documents: ``shard``, ``block``, ``first_doc``, ``last_doc`` (for pruning), ``start`` (ids in the
shard before it), ``n_tokens`` and ``payload``. A payload is little-endian: magic ``RPR1``; u32 bytes of a symbol (2 or
4), first nonterminal, rules, symbols, documents; the rules' left symbols, then their right symbols, then their
expansion lengths (u32); the symbols of the sequence; the documents' ids (i64, with a bitmap byte each for null) and
lengths (u32). Expansion lengths let a reader find the symbols of any range without expanding what stands before it. A
block's grammar is its own, so a block is what Re-Pair calls a file: about ``block_tokens`` ids, or one longer document.

Defined cases: a null text is an empty one; an empty text is the end id alone; equal doc_ids follow one another in the
order of the table's rows; null doc_ids come first; a long text makes one block; an empty table gives no blocks; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import shuffle_partitions, table_path
from .textbytes import text_slices, thrifty
from .tokens import default_path, word_bpe

MAGIC = b"RPR1"
BLOCKS = "shard int, block int, first_doc long, last_doc long, start long, n_tokens long, payload binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: A pair that occurs this often is frequent: it pays for its rule.
FREQUENT = 8


def _frequent_pairs(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, counts, at, which): the sorted keys that occur ``least`` times or more; the places of their occurrences in order, and each one's pair.

    Keys that are rare even together with those of the same fold aren't sorted.
    """
    fold = ((keys * keys.dtype.type(0x9E3779B1)) >> keys.dtype.type(keys.dtype.itemsize * 8 - 18)).astype(np.int64)
    at = np.flatnonzero((np.bincount(fold, minlength=1 << 18) >= least)[fold])
    own = keys[at]
    ordered = np.sort(own)
    cut = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.append(cut, len(ordered)))
    cut, counts = cut[counts >= least], counts[counts >= least]
    pairs = ordered[cut]
    if not len(pairs):
        return pairs, counts, at[:0], at[:0]
    which = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
    hit = pairs[which] == own
    return pairs, counts, at[hit], which[hit]


def repair(ids: np.ndarray, least: int = FREQUENT) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first nonterminal, left, right, expansion lengths) of a Re-Pair grammar of ``ids``.

    A round replaces all pairs that occur ``least`` times or more; where occurrences overlap, the more frequent pair has
    it, and of equals every other one from the left. Rounds go on until no pair is frequent.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    kind, shift = (np.uint32, 16) if base <= 1 << 16 else (np.uint64, 32)
    seq, lengths = ids.astype(kind), [np.ones(0, np.int64)]
    lefts, rights, top = [], [], base
    open_ = np.arange(max(0, len(seq) - 1))  # pairs elsewhere can't have become frequent
    while len(open_):
        pairs, counts, at, which = _frequent_pairs((seq[open_] << kind(shift)) | seq[open_ + 1], least)
        at = open_[at]
        if not len(pairs):
            break
        if kind is np.uint32 and top + len(pairs) > 1 << 16:  # symbols of more than 16 bits from here on
            kind, shift, seq = np.uint64, 32, seq.astype(np.uint64)
            continue
        touch = np.diff(at) == 1
        lower, higher = counts[which[1:]] < counts[which[:-1]], counts[which[1:]] > counts[which[:-1]]
        wins = np.ones(len(at), bool)
        wins[1:] &= ~(touch & lower)
        wins[:-1] &= ~(touch & higher)
        again = np.zeros(len(seq), bool)
        again[at] = True
        at, which = at[wins], which[wins]
        if len(touching := np.flatnonzero(np.diff(at) == 1)):
            run = np.ones(len(at), bool)
            run[touching + 1] = False
            even = (np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0
            at, which = at[even], which[even]
        times = np.bincount(which, minlength=len(pairs))
        used = np.flatnonzero(times)
        which = (np.cumsum(times > 0) - 1)[which]
        left, right = pairs[used] >> kind(shift), pairs[used] & kind((1 << shift) - 1)
        known = np.concatenate(lengths)
        own = [np.where(s < base, 1, known[np.maximum(s.astype(np.int64) - base, 0)] if len(known) else 1) for s in (left, right)]
        lefts.append(left)
        rights.append(right)
        lengths.append(own[0] + own[1])
        seq = seq.copy()
        seq[at] = (top + which).astype(kind)
        again[at] = True
        again[np.maximum(at, 1) - 1] = True  # pairs that begin or end with the new symbols
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, top = seq[keep], top + len(used)
        open_ = np.flatnonzero(again[keep][:-1])
    join = lambda x: np.concatenate([y.astype(np.uint32) for y in x]) if x else np.zeros(0, np.uint32)
    return seq.astype(np.uint32), base, join(lefts), join(rights), np.concatenate(lengths).astype(np.uint32)


def _expanded_rules(base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The terminals of all rules, one after another: every round replaces the nonterminals that are left by their two symbols."""
    seq = np.arange(base, base + len(left), dtype=np.int64)
    while (rule := seq >= base).any():
        at = np.cumsum(1 + rule) - 1 - rule
        out = np.empty(len(seq) + int(rule.sum()), np.int64)
        out[at] = np.where(rule, left[np.where(rule, seq - base, 0)], seq)
        out[at[rule] + 1] = right[seq[rule] - base]
        seq = out
    return seq.astype("<u4")


def expand(symbols: np.ndarray, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for: rules are expanded once and copied to their places."""
    rule = symbols >= base
    if not rule.any():
        return symbols.astype("<u4")
    of_rules, lengths = _expanded_rules(base, left, right), lengths.astype(np.int64)
    first, which = np.cumsum(lengths) - lengths, symbols[rule].astype(np.int64) - base
    sizes = np.ones(len(symbols), np.int64)
    sizes[rule] = lengths[which]
    out = np.repeat(symbols.astype("<u4"), sizes)
    begin, own = (np.cumsum(sizes) - sizes)[rule], lengths[which]
    within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    out[np.repeat(begin, own) + within] = of_rules[np.repeat(first[which], own) + within]
    return out


def to_payload(ids: np.ndarray, docs: list[int | None], n_tokens: list[int]) -> bytes:
    symbols, base, left, right, lengths = repair(ids)
    wide = 2 if base + len(left) <= 1 << 16 else 4
    as_symbols = lambda x: x.astype(f"<u{wide}").tobytes()
    head = MAGIC + struct.pack("<5I", wide, base, len(left), len(symbols), len(docs))
    null = np.array([d is None for d in docs], np.uint8).tobytes()
    return b"".join((head, as_symbols(left), as_symbols(right), lengths.astype("<u4").tobytes(), as_symbols(symbols), np.array([d or 0 for d in docs], "<i8").tobytes(), null, np.array(n_tokens, "<u4").tobytes()))


class Block:
    """A payload that is open for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of this format")
        wide, self.base, n_rules, n_symbols, n_docs = struct.unpack_from("<5I", payload, 4)
        at = 24

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right = (take(n_rules, f"<u{wide}").astype(np.int64) for _ in range(2))
        self.lengths, self.symbols = take(n_rules, "<u4").astype(np.int64), take(n_symbols, f"<u{wide}")
        docs, null = take(n_docs, "<i8"), take(n_docs, "u1")
        self.docs = [None if x else int(d) for d, x in zip(docs, null)]
        self.starts = np.concatenate(([0], np.cumsum(take(n_docs, "<u4").astype(np.int64))))
        own = self.symbols.astype(np.int64)
        rule = own >= self.base
        sizes = np.ones(len(own), np.int64)
        sizes[rule] = self.lengths[own[rule] - self.base]
        self.ends = np.cumsum(sizes)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` up to ``end``; only the symbols that cover them are expanded."""
        if start >= end:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, end, "left") + 1
        before = int(self.ends[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.base, self.left, self.right, self.lengths)[start - before : end - before]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _to_blocks(batches: Iterable[pa.RecordBatch], path: str, end_id: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard, bpe = TaskContext.get().partitionId(), word_bpe(path)
    data, docs, sizes, held, start, number = [], [], [], 0, 0, 0
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def block() -> pa.RecordBatch:
        payload = to_payload(np.concatenate(data), docs, sizes)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, number, docs[0], docs[-1], start, held, payload), schema)], schema=schema)

    for batch in batches:
        for part in text_slices(batch):
            ids, at = bpe.encode(part.column(1), end_id)
            names, i = part.column(0).to_pylist(), 0
            while i < len(names):
                j = min(len(names), int(np.searchsorted(at, at[i] + block_tokens - held)))  # the first that fills the block ends it
                data.append(ids[at[i] : at[j]])
                docs += names[i:j]
                sizes += np.diff(at[i : j + 1]).tolist()
                held += int(at[j] - at[i])
                i = j
                if held >= block_tokens:
                    yield block()
                    start, number, held = start + held, number + 1, 0
                    data, docs, sizes = [], [], []
    if docs:
        yield block()


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, block_tokens: int = 1 << 18, shards: int | None = None) -> None:
    """Write the ids of every text of ``docs`` (doc_id, text) to ``folder``, in ascending doc_id order.

    A range shuffle puts the shards in order; the row's number lets it part equal doc_ids.
    """
    path = path or default_path()
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shards or shuffle_partitions(docs.sparkSession), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    dealt.select("doc_id", "text").mapInArrow(thrifty(lambda b: _to_blocks(b, path, end_id, block_tokens)), BLOCKS).write.parquet(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files; ``with_ids`` adds its ids.

    The shards' totals (a number each) are summed up on the driver to find where each shard starts.
    """
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    totals = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    base = dict(zip((s for s, _ in totals), np.concatenate(([0], np.cumsum([n for _, n in totals]))).tolist()))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, payload in zip(*(batch.column(i) for i in range(3))):
                block = Block(payload.as_py())
                ids = expand(block.symbols, block.base, block.left, block.right, block.lengths)
                first = base[shard.as_py()] + start.as_py()
                cuts, data = block.starts.tolist(), memoryview(ids).cast("B")
                out = [pa.array(block.docs, pa.int64()), pa.array(first + block.starts[:-1]), pa.array(np.diff(block.starts)), pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return blocks.select("shard", "start", "payload").mapInArrow(thrifty(decode), DOCUMENTS + ", ids array<long>" * with_ids)


def lookup(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this doc_id; the files' statistics and the expansion lengths leave the rest unread."""
    rows = spark.read.schema(BLOCKS).parquet(folder).filter((F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)) & (F.col("last_doc") >= doc_id)).orderBy("shard", "block").select("payload").collect()
    opened = (Block(bytes(r.payload)) for r in rows)
    return [b.document(i) for b in opened for i, d in enumerate(b.docs) if d == doc_id]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to a fresh folder that all executors share and read the files back."""
    folder = table_path(docs.sparkSession, "tokens")
    write(docs, folder, path)
    return read(docs.sparkSession, folder)
