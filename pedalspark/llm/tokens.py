"""Ids of a public tokenizer for whole Arrow columns, with its chunks kept in a bounded cache of the Python worker."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbytes import PIECE, utf8

#: The letters, digits and white space of Latin-1 after lower-casing, and the tokenizer's own word pattern over them.
_LETTERS, _DIGITS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
#: What the file must say for texts to be cut here; any other file is left to the library.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_alphabet() -> dict[int, int]:
    """Bytes to the characters that byte-level models know them by: printable ones stay, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``text`` cut at blanks into parts of at most ``size`` bytes; a longer run without a blank is a part of its own."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(b" ", at, at + size)
        cut = cut if cut > at else text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class WordBpe:
    """``encode(column)``: the library's ``encode(text, add_special_tokens=False).ids`` of each text.

    The tokenizer drops white space and never merges across its words. So the distinct blank-separated chunks of a batch
    are looked up; new ones are cut into words by the tokenizer's pattern, and new words go to the tokenizer's model by
    their bytes. Texts of other than Latin-1 characters have their chunks encoded by the library. A tokenizer file of
    another kind has its whole texts encoded by the library. The cache keeps the first chunks
    and empties its second half when that is full; long chunks are not kept.
    """

    def __init__(self, path: str, limit: int = 500_000, longest: int = 48):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.longest = Tokenizer.from_file(path), limit, longest
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.alphabet = byte_alphabet()
        self.chunks: dict[str, bytes] = {}  # lower-cased Latin-1; the first ones, which are the frequent ones, stay
        self.recent: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            self.known = self._is_known(json.load(file))

    @staticmethod
    def _is_known(file: dict) -> bool:
        steps = [x.get("type") for x in (file.get("normalizer") or {}).get("normalizers", [])]
        cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        by_pattern = len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": _PATTERN} and cuts[0].get("invert") is True and cuts[0].get("behavior") == "Removed"
        by_bytes = by_pattern and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space") and cuts[1].get("use_regex") is False
        specials = all("<|" in x["content"] for x in file.get("added_tokens", []))
        return by_bytes and specials and steps == _NORMALIZER and file.get("model", {}).get("end_of_word_suffix") == "</w>" and not file["model"].get("dropout")

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids as unsigned 32-bit, offsets): text i has ids[offsets[i]:offsets[i + 1]], with ``end`` after each text's own."""
        buf, at = utf8(column)
        long_ = np.flatnonzero(np.diff(at) > PIECE)
        beyond = np.flatnonzero(buf > 0xC3) if self.known else np.zeros(0, np.int64)  # first bytes of characters past Latin-1
        odd = set((np.searchsorted(at, beyond, "right") - 1).tolist()) | set(long_.tolist())
        if len(column) and self.known:
            odd |= set(np.flatnonzero(pc.match_substring(column.fill_null(""), "<|").to_numpy(zero_copy_only=False)).tolist())
        if not self.known:
            odd = set(range(len(column)))
        if not odd:
            ids, offsets = self._latin(column)
        else:
            own = {i: self._odd(buf[at[i] : at[i + 1]].tobytes()) for i in odd}
            plain = np.array([i for i in range(len(column)) if i not in odd], np.int64)
            rest, cuts = self._latin(column.take(pa.array(plain)))
            sizes = np.zeros(len(column), np.int64)
            sizes[plain] = np.diff(cuts)
            for i, x in own.items():
                sizes[i] = len(x)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            ids = np.empty(offsets[-1], "<u4")
            is_plain = np.zeros(len(column), bool)
            is_plain[plain] = True
            ids[np.repeat(is_plain, sizes)] = rest
            for i, x in own.items():
                ids[offsets[i] : offsets[i + 1]] = x
        if end is None:
            return ids, offsets
        out = np.empty(len(ids) + len(column), "<u4")
        ends = offsets[1:] + np.arange(len(column))
        mine = np.ones(len(out), bool)
        mine[ends] = False
        out[mine], out[ends] = ids, end
        return out, offsets + np.arange(len(column) + 1)

    def _latin(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that are Latin-1 and without added tokens."""
        if not len(column):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        lists = pc.ascii_split_whitespace(pc.utf8_lower(column.fill_null("")))
        cuts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
        parts, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.chunks.get, parts))
        if None in found:
            if len(self.recent) > self.limit // 2:
                self.recent = {}
            found = [self.recent.get(x) or self._chunk(x) if own is None else own for x, own in zip(parts, found)]
        data = np.frombuffer(b"".join(found), "<u4")
        each = np.fromiter(map(len, found), np.int64, len(found)) // 4
        sizes = each[which]
        places = np.concatenate(([0], np.cumsum(sizes)))
        begin = (np.cumsum(each) - each)[which] - places[:-1]
        return data[np.repeat(begin, sizes) + np.arange(places[-1])], places[cuts - cuts[0]]

    def _chunk(self, x: str) -> bytes:
        words = _WORDS.findall(x)
        if len(words) == 1 and words[0] == x:
            coded = x if x.isascii() and x.isalpha() else x.encode().decode("latin-1").translate(self.alphabet)
            out = b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(coded)])
        else:
            out = b"".join([self.chunks.get(w) or self.recent.get(w) or self._chunk(w) for w in words])
        if len(x) <= self.longest:
            (self.chunks if len(self.chunks) < self.limit // 2 else self.recent)[x] = out
        return out

    def _odd(self, text: bytes) -> np.ndarray:
        """Long texts in pieces; those that are not Latin-1, or have what may be an added token, by the library."""
        if self.known and len(text) > PIECE and b"<|" not in text:
            return np.concatenate([self.encode(pa.array([x.decode()]))[0] if len(x) <= PIECE else self._whole(x.decode()) for x in pieces(text)])
        return self._whole(text.decode())

    def _whole(self, text: str) -> np.ndarray:
        if not self.known:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        out = []
        for x in text.replace("\n", " ").split(" "):
            own = self.others.get(x)
            if own is None:
                own = np.asarray(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
                if len(x) <= self.longest:
                    self.others[x] = own
            out.append(own)
        if len(self.others) > self.limit // 4:
            self.others = {}
        return np.frombuffer(b"".join(out), "<u4")


@functools.lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
