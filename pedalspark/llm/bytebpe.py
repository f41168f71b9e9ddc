"""Byte-level BPE of texts of any length: halves are encoded apart and joined exactly; decoding is a table of bytes.

A text of at most ``leaf`` bytes is encoded where it is read. A longer one is halved down to leaves, which are dealt out
over tasks and encoded in parallel; neighbouring encodings are then joined pair by pair, as a tree (``joined``):

1. Words. The tokenizer cuts a text into words from left to right and looks at most ``AHEAD`` characters past a word's
   end, so the left side's words but for the last few are the whole text's. A window from such a word of the left side
   to a word of the right side is encoded again and grows until both have a word that starts at one place there: from
   there on, both scans are one.
2. One long word across the join, as in text without a blank. Ids are a word's encoding if each two neighbours are one's
   (Berglund and van der Merwe, 2023). So only ids around the join are encoded again, in a window that doubles until its
   first id is the left side's own and its last id is the right side's own; the outer ids then stand as they are.

Defined cases: a null text is an empty one and has no ids; repeated rows are encoded each; nothing is ranked, so there
are no ties; a text of any length is encoded whole, its ids stand in one value at the end; ids that are no encoding of
a text decode with replacement characters, as the library has it; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import text_slices, thrifty, utf8
from .tokens import byte_alphabet

#: Bytes of the largest text that is encoded in one piece.
LEAF = 1 << 14
#: Bytes that hold any three characters: no word's end depends on text further than that behind it.
AHEAD = 12
#: Ids on each side of the first window, and the ids from which a word is joined by its ids.
WINDOW, LONG_WORD = 16, 256
#: Words in the cache of a Python worker, and the longest one there.
CACHED, LONGEST = 400_000, 48

# The letters, digits and white space of Latin-1, and the tokenizer's word pattern over them.
_LETTERS, _DIGITS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_LATIN = re.compile("[\x00-\xff]*")

Encoded = tuple[np.ndarray, np.ndarray]  # ids as unsigned 32-bit; whether each begins a word


class _Cache(dict):
    """Words' ids as bytes, found when they are first asked for."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = self.bpe.of_bytes(word.encode())
        if len(word) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """A byte-level BPE file of the tokenizers library, without normalizer and with its own word pattern."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        cut = told.get("pre_tokenizer") or {}
        if told.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or told["model"].get("dropout"):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.alphabet = byte_alphabet()
        self.added = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")) for x in told.get("added_tokens", []))
        if not plain or len(self.added) > 1:
            raise ValueError(f"{path}: added tokens of another kind")
        self.special = re.compile("|".join(map(re.escape, self.added)) or "(?!)")
        back = {chr(c): b for b, c in byte_alphabet().items()}
        known = [bytes(back.get(c, ord(c) & 255) for c in self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())]
        for content, i in self.added.items():
            known[i] = content.encode()
        self.sizes = np.array([len(x) for x in known], np.int64)
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(known), np.uint8)
        self.packed = [i.to_bytes(4, "little") for i in range(len(known))]
        self.cache = _Cache(self)

    def of_bytes(self, word: bytes) -> bytes:
        """The ids of one word by the model alone."""
        return b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.alphabet))])

    def words(self, text: str) -> list[str]:
        """The tokenizer's words of a text without added tokens; beyond Latin-1 the library cuts them."""
        if _LATIN.fullmatch(text):
            return _WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, text: str) -> bytes:
        """``text`` in one piece, without the places of words."""
        if not self.added or not self.special.search(text):
            return b"".join(map(self.cache.__getitem__, self.words(text)))
        return self.leaf(text)[0].tobytes()

    def leaf(self, text: str) -> Encoded:
        """``text`` in one piece."""
        found, at = [], 0
        for m in self.special.finditer(text):
            found += [self.cache[w] for w in self.words(text[at : m.start()])] + [self.packed[self.added[m.group()]]]
            at = m.end()
        found += [self.cache[w] for w in self.words(text[at:])]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        heads = np.zeros(sizes.sum(), bool)
        heads[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return np.frombuffer(b"".join(found), "<u4"), heads

    def cuts(self, text: str, leaf: int) -> list[str]:
        """``text`` halved until no part has more than ``leaf`` bytes, never inside an added token."""
        if len(text.encode()) <= leaf or len(text) < 2:
            return [text]
        at = len(text) // 2
        longest = max(map(len, self.added), default=0)
        for m in self.special.finditer(text, max(0, at - longest), at + longest):
            if m.start() < at < m.end():
                at = m.start() or m.end()
        if at == len(text):
            return [text]
        return self.cuts(text[:at], leaf) + self.cuts(text[at:], leaf)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.bytes_of(np.frombuffer(ids, "<u4")).decode("utf-8", "replace")

    def _one_word(self, a: Encoded, b: Encoded) -> Encoded | None:
        """The join where one long word crosses it whole, by windows of ids; None elsewhere."""
        i = int(np.flatnonzero(a[1])[-1])
        later = np.flatnonzero(b[1][1:])
        j = int(later[0]) + 1 if len(later) else len(b[0])
        left, right = a[0][i:], b[0][:j]
        own = {*self.added.values()}
        if len(left) + len(right) < LONG_WORD or int(left[0]) in own or int(right[0]) in own:
            return None
        before, word = self.bytes_of(left), self.bytes_of(left) + self.bytes_of(right)
        behind = self.bytes_of(b[0][j : j + AHEAD])
        if i and len(before) < AHEAD:
            return None
        first = self.special.split(behind.decode("utf-8", "ignore"))[0]
        if self.words(word.decode() + first)[0].encode() != word:
            return None
        k = WINDOW
        while True:
            x, y = left[-k:], right[:k]
            new = np.frombuffer(self.of_bytes(self.bytes_of(x) + self.bytes_of(y)), "<u4")
            if (len(x) == len(left) or new[0] == x[0]) and (len(y) == len(right) or new[-1] == y[-1]):
                break
            k *= 2
        ids = np.concatenate((a[0][:i], left[: len(left) - len(x)], new, right[len(y) :], b[0][j:]))
        heads = np.concatenate((a[1][:i], np.zeros(len(ids) - i - len(b[0]) + j, bool), b[1][j:]))
        heads[i] = True
        return ids, heads

    def join(self, a: Encoded, b: Encoded) -> Encoded:
        """The encoding of two texts as one, of their encodings."""
        if not len(a[0]) or not len(b[0]):
            return b if not len(a[0]) else a
        whole = self._one_word(a, b)
        if whole is not None:
            return whole
        heads, k = np.flatnonzero(a[1]), WINDOW
        tail = np.cumsum(self.sizes[a[0][::-1].astype(np.int64)])[::-1]  # bytes from each id to the end
        safe = heads[(tail[heads] >= AHEAD) & (heads <= max(0, len(a[0]) - k))]
        i = int(safe[-1]) if len(safe) else 0
        left = self.bytes_of(a[0][i:])
        starts = np.flatnonzero(b[1])
        while True:
            after = starts[starts >= k]
            j = int(after[0]) if len(after) else len(b[0])
            text = left + self.bytes_of(b[0][:j])
            ids, own = self.leaf(text.decode())
            if j == len(b[0]):
                return np.concatenate((a[0][:i], ids)), np.concatenate((a[1][:i], own))
            at, theirs = np.cumsum(self.sizes[ids.astype(np.int64)]), np.cumsum(self.sizes[b[0][:j].astype(np.int64)]) + len(left)
            mine = (at - self.sizes[ids.astype(np.int64)])[own]
            same = np.intersect1d(mine, (theirs - self.sizes[b[0][:j].astype(np.int64)])[b[1][:j]])
            same = same[(same >= len(left)) & (same <= len(text) - AHEAD)]
            if len(same):
                m, n = int(np.searchsorted(at, same[0], "right")), int(np.searchsorted(theirs, same[0], "right"))
                return np.concatenate((a[0][:i], ids[:m], b[0][n:])), np.concatenate((a[1][:i], own[:m], b[1][n:]))
            k *= 2

    def joined(self, parts: list[Encoded]) -> Encoded:
        """Neighbours joined pair by pair, until one encoding is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


@functools.lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text)."""
    path = path or default_path()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for part in text_slices(batch):
                ids = [bpe.ids(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = bpe.cuts(batch.column(2)[i].as_py(), leaf)
                at = pa.array(np.full(len(parts), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["row", "doc_id", "leaf", "text"])

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for part in text_slices(batch):
                found = [bpe.leaf(x) for x in part.column(3).to_pylist()]
                ids, heads = (pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], ids, heads], ["row", "doc_id", "leaf", "ids", "heads"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("leaf")
        parts = [(np.frombuffer(x, "<u4"), np.frombuffer(y, bool)) for x, y in zip(table["ids"].to_pylist(), table["heads"].to_pylist())]
        ids = byte_bpe(path).joined(parts)[0].tobytes()
        return pa.table([table["doc_id"].slice(0, 1), pa.array([ids], pa.binary())], ["doc_id", "ids"])

    size, out = F.octet_length("text"), f"doc_id {kind}, ids binary"
    short = rows.filter(size <= leaf).mapInArrow(thrifty(whole), out)
    long_ = rows.filter(size > leaf).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    dealt = long_.mapInArrow(cut, f"row long, doc_id {kind}, leaf int, text string").repartition("row", "leaf")
    parts = dealt.mapInArrow(thrifty(leaves), f"row long, doc_id {kind}, leaf int, ids binary, heads binary")
    return short.unionByName(parts.groupBy("row").applyInArrow(join, out))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text of its ids."""
    path = path or default_path()
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            texts = [bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(thrifty(run), f"doc_id {kind}, ids binary, text string")


def round_trip(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of every row's ids and of the text that they decode to."""
    rows = decode(encode(docs, path, leaf), path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
