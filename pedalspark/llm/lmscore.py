"""Cross-entropy difference of matched bigram models (Moore and Lewis, 2010).

Both models know every word and every bigram of all documents: those of the target make one model, all the background.
The background's counts are scaled to the target's total, so that both models are smoothed alike: towards their own
unigrams, with a weight of MU.

What is gathered grows with the corpus and meets in the executors only. Bigrams are dealt by their word over parts of
about PART tokens, packed by slices of documents; a part counts its bigrams, their words and these words as histories,
and returns each slice's sums of losses. Words of too many tokens for one part are spread by their bigrams; their own
counts are sent to the executors, at most 8 words for each part and ``MOST_HOT`` in all, as are the ``COMMON`` most
frequent words, which have codes of two bytes as histories. A loss is -log(n(a, b) + MU p(b)) + log(n(a) + MU):
the second half belongs to the part of a.

A document's losses are means over its tokens; ``score`` is the target's loss less the background's: lower is closer
to the target.

Defined cases: null, empty and wordless texts have no tokens and null losses; an empty target leaves uniform
probabilities; repeated rows are counted and scored each; equal scores are no case of their own, as nothing is ranked; a
text of any length is a slice of its own, whose tokens are dealt out like all others; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import stored
from .textbytes import mix, spans, text_slices, thrifty, utf8, word_hashes

VOCABULARY, MU = 2048, 500.0  # places for words, used or not; more if there are more words
PART = 1 << 21  # tokens
START, END = np.uint64(1), np.uint64(2)  # stand for the words before and after a text

#: Bytes of words: ASCII letters and digits, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
for _range in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    ALNUM[list(_range)] = True

#: Words of the short code, the most frequent ones, and the most words that are held by every executor.
COMMON, MOST_HOT = 60_000, 1 << 20
_OTHER = 0xFFFF

_PACKED = ("words", "pairs", "before", "rest", "tokens", "docs", "target", "ids", "n", "s0", "s1")


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = utf8(column)
    starts, ends, first = spans(buf, offsets, ALNUM)
    return word_hashes(buf, starts, ends, lower=True), first


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts; words are hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=1 << 23):
                words, n = np.unique(hashed_words(part.column(0))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(thrifty(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def places(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """-1 for words that are not in the sorted ``known``, else their place in it."""
    if not len(known):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, -1)


def histories(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each token; START at a text's start."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    starts = first[:-1]
    before[starts[starts < len(words)]] = START
    return before


class Totals:
    """Texts, tokens and the frequent words' counts (as words, as last words) of [target, all]."""

    def __init__(self, docs: DataFrame, ids: DataFrame):
        counts = stored(word_counts(docs), "words")
        size, tokens = counts.agg(F.count("*"), F.sum("n")).first()
        self.size, self.parts = max(VOCABULARY, size), -(-(tokens or 0) // PART) or 1
        least = max(2, (tokens or 0) // (8 * min(self.parts, MOST_HOT // 8)))
        self.hot = hot = np.sort(np.array([r.word for r in counts.filter(F.col("n") >= least).select("word").collect()], np.int64).view(np.uint64))
        frequent = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(COMMON).collect()]
        self.common = np.sort(np.concatenate((np.array(frequent, np.int64).view(np.uint64), [START, END])))
        width = 2 * len(hot) + 2

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch):
                    words, first = hashed_words(part.column(1))
                    at, cuts = places(words, hot).astype("<i4"), first.tolist()
                    own = [at[i:j] for i, j in zip(cuts, cuts[1:])]
                    last = [x[-1] if len(x) else -1 for x in own]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array([x[x >= 0].tobytes() for x in own], pa.binary()), pa.array(np.array(last, np.int32))], ["doc_id", "n", "hot", "last"])

        def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, width), np.int64)
            for batch in batches:
                n, last = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                target = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
                for k, rows in ((0, target), (1, np.ones(len(n), bool))):
                    found = b"".join(x for x, some in zip(batch.column(1).to_pylist(), rows) if some)
                    ends = last[rows & (last >= 0)]
                    sums[k] += np.concatenate(([(n[rows] > 0).sum(), n[rows].sum()], np.bincount(np.frombuffer(found, "<i4"), minlength=len(hot)), np.bincount(ends, minlength=len(hot)))).astype(np.int64)
            at = np.flatnonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["at", "target", "all"])

        rows = docs.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id long, n long, hot binary, last int").join(ids.hint("merge"), "doc_id", "left")
        sums = rows.select("n", "hot", "last", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(thrifty(total), "at long, target long, all long").groupBy("at").agg(F.sum("target"), F.sum("all")).collect()
        found = np.zeros((2, width))
        for at, n_target, n_all in sums:  # the frequent words and two
            found[:, at] = n_target, n_all
        self.texts, self.tokens, self.n, last = found[:, 0], found[:, 1], found[:, 2 : 2 + len(hot)], found[:, 2 + len(hot) :]
        self.scale = np.array([1.0, self.tokens[0] / self.tokens[1] if self.tokens.all() else 1.0])
        self.history = np.log((self.n - last) * self.scale[:, None] + MU)
        self.start = np.log(self.texts * self.scale + MU)

    def unigram(self, k: int, n: np.ndarray) -> np.ndarray:
        return (n * self.scale[k] + 1) / (self.tokens[k] * self.scale[k] + self.size)


def coded(before: np.ndarray, common: np.ndarray) -> tuple[bytes, bytes]:
    """Histories in two bytes each where they are in ``common``, and the others in eight."""
    at = places(before, common)
    return np.where(at < 0, _OTHER, at).astype("<u2").tobytes(), before[at < 0].astype("<u8").tobytes()


def decoded(codes: np.ndarray, rest: np.ndarray, common: np.ndarray) -> np.ndarray:
    other = codes == _OTHER
    out = common[np.where(other, 0, codes)]
    out[other] = rest
    return out


def packed(part: pa.RecordBatch, totals: Totals) -> Iterator[dict]:
    """The slice (doc_id, text, target): one row with its documents, and one for each part with the bigrams dealt there."""
    words, first = hashed_words(part.column(1))
    n, before = np.diff(first), histories(words, first)
    buf, offsets = utf8(part.column(1))
    ids, null = part.column(0).fill_null(0).to_numpy().astype("<i8"), part.column(0).is_null().to_numpy(zero_copy_only=False)
    ids = np.where(null, 0, ids).tobytes() + null.astype("u1").tobytes()
    name = hashlib.blake2b(ids + offsets.astype("<i8").tobytes(), digest_size=16)
    name.update(np.ascontiguousarray(buf))
    key, docs = name.digest(), np.repeat(np.arange(len(n)), n)
    target = part.column(2).to_numpy(zero_copy_only=False).astype("u1").tobytes()
    # the halves of frequent histories are known here
    at, own = places(before, totals.hot), []
    for k in range(2):
        known = np.append(totals.history[k], 0.0)[at]
        known[before == START] = totals.start[k]
        own.append(np.bincount(docs, known, len(n)).astype("<f8").tobytes())
    yield {"slice": key, "part": int.from_bytes(key[:4], "little") % totals.parts, "ids": ids, "n": n.astype("<i8").tobytes(), "s0": own[0], "s1": own[1]}
    last = words[first[1:][n > 0] - 1]
    rare = places(last, totals.hot) < 0
    words, before = np.concatenate((words, last[rare])), np.concatenate((before, np.full(rare.sum(), END)))
    docs = np.concatenate((docs, np.flatnonzero(n > 0)[rare])).astype("<u4" if len(n) > 1 << 16 else "<u2")
    spread = np.where(places(words, totals.hot) < 0, words, mix(words + before * np.uint64(0x9E3779B97F4A7C15)))
    dealt = ((spread >> np.uint64(20)) % np.uint64(totals.parts)).astype(np.int64)
    order = np.lexsort((before, words, dealt))
    words, before, docs, dealt = words[order], before[order], docs[order], dealt[order]
    new_word = np.append(True, (words[1:] != words[:-1]) | (dealt[1:] != dealt[:-1])) if len(words) else np.zeros(0, bool)
    new_pair = new_word.copy()
    new_pair[1:] |= before[1:] != before[:-1]
    cuts = np.searchsorted(dealt, np.arange(totals.parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        i, j = cuts[p], cuts[p + 1]
        pairs = np.flatnonzero(new_pair[i:j])
        at = np.flatnonzero(new_word[i:j][pairs])
        codes, rest = coded(before[i:j][pairs], totals.common)
        yield {
            "slice": key,
            "part": p,
            "words": words[i:j][pairs[at]].astype("<u8").tobytes(),
            "pairs": np.diff(np.append(at, len(pairs))).astype("<u4").tobytes(),
            "before": codes,
            "rest": rest,
            "tokens": np.diff(np.append(pairs, j - i)).astype("<u4").tobytes(),
            "docs": docs[i:j].tobytes(),
            "target": target,
        }


def part_losses(table: pa.Table, totals: Totals) -> list[dict]:
    """The rows of documents as they are; for each slice's bigrams the sums of their losses by document."""
    rows = table.to_pylist()
    out = [{k: r[k] for k in ("slice", "ids", "n", "s0", "s1")} | {"part": -1} for r in rows if r["ids"] is not None]
    rows = sorted((r for r in rows if r["ids"] is None), key=lambda r: r["slice"])
    if not rows:
        return out
    join = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    words, tokens = np.repeat(join("words", "<u8"), join("pairs", "<u4")), join("tokens", "<u4").astype(np.int64)
    before = decoded(join("before", "<u2"), join("rest", "<u8"), totals.common)
    docs = [np.frombuffer(r["docs"], "<u4" if len(r["target"]) > 1 << 16 else "<u2") for r in rows]
    n_target = np.add.reduceat(np.concatenate([np.frombuffer(r["target"], "u1")[d] for r, d in zip(rows, docs)]).astype(np.int64), np.cumsum(tokens) - tokens)
    order = np.lexsort((before, words))
    w, b = words[order], before[order]
    new = np.append(True, (w[1:] != w[:-1]))
    word = np.empty(len(w), np.int64)
    word[order] = np.cumsum(new) - 1
    pair = np.empty(len(w), np.int64)
    pair[order] = np.cumsum(new | np.append(True, b[1:] != b[:-1])) - 1
    at, end = places(w[new], totals.hot), before == END
    rare, losses = at < 0, []
    for k, n in enumerate((n_target, tokens)):
        of_pair, of_word, ends = np.bincount(pair, n), np.bincount(word, np.where(end, 0, n)), np.bincount(word, np.where(end, n, 0))
        history = np.where(rare, np.log((of_word - ends) * totals.scale[k] + MU), 0.0)
        if len(totals.hot):
            of_word = np.where(rare, of_word, totals.n[k][at])
        loss = history[word] - np.log(of_pair[pair] * totals.scale[k] + MU * totals.unigram(k, of_word)[word])
        losses.append(np.repeat(np.where(end, -history[word], loss), tokens))
    i = 0
    for r, d in zip(rows, docs):
        some = np.flatnonzero(np.bincount(d))
        s = [np.bincount(d, x[i : i + len(d)])[some].astype("<f4").tobytes() for x in losses]
        out.append({"slice": r["slice"], "part": r["part"], "n": some.astype("<i4").tobytes(), "s0": s[0], "s1": s[1]})
        i += len(d)
    return out


def slice_scores(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    copies = sum(r["ids"] is not None for r in rows)  # slices of equal rows have one key
    n = np.frombuffer(rows[0]["n"], "<i8")
    ids, null = np.frombuffer(rows[0]["ids"][: 8 * len(n)], "<i8"), np.frombuffer(rows[0]["ids"][8 * len(n) :], "u1").astype(bool)
    sums = np.zeros((2, len(n)))
    for r in rows:
        at = slice(None) if r["ids"] is not None else np.frombuffer(r["n"], "<i4")
        for k in range(2):
            sums[k, at] += np.frombuffer(r[f"s{k}"], "<f8" if r["ids"] is not None else "<f4")
    loss = sums / np.maximum(n, 1) / copies
    columns = [pa.array(x, mask=n == 0) for x in (*loss, loss[0] - loss[1])]
    one = pa.table([pa.array(ids, mask=null), pa.array(n), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])
    return pa.concat_tables([one] * copies)


def scores(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of ``docs``; ``target`` has the doc_ids of the target."""
    spark = docs.sparkSession
    ids = target.filter("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("target", F.lit(True))
    totals = spark.sparkContext.broadcast(Totals(docs, ids))
    # The merge hint: texts cross the network once, at any number of targets; without it small inputs take another plan.
    flagged = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    dealt = pa.schema([("slice", pa.binary()), ("part", pa.int32()), *((name, pa.binary()) for name in _PACKED)])
    summed = pa.schema([("slice", pa.binary()), ("part", pa.int32()), *((name, pa.binary()) for name in ("ids", "n", "s0", "s1"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=1 << 23):
                for row in packed(part, totals.value):
                    yield pa.RecordBatch.from_pylist([row], schema=dealt)

    binary = lambda schema: "slice binary, part int, " + ", ".join(f"{name} binary" for name in schema.names[2:])
    by_part = flagged.mapInArrow(thrifty(run), binary(dealt)).groupBy("part").applyInArrow(lambda t: pa.Table.from_pylist(part_losses(t, totals.value), schema=summed), binary(summed))
    return by_part.groupBy("slice").applyInArrow(slice_scores, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
