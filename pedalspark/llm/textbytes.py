"""Words and shingles of whole Arrow batches, found and hashed on the UTF-8 bytes with numpy."""

from __future__ import annotations

import ctypes
import hashlib
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18  # bytes that are hashed at once
PIECE = 1 << 20  # bytes that are searched or counted at once
SLICE = 1 << 20  # bytes of text that an operator takes from a batch at once
_BASE = 0x9E3779B97F4A7C15 | 1
_SPREAD = np.uint64(_BASE)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Lower-cases A-Z and nothing else.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of words that ASCII white space parts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


#: Masks of the first 0 to 8 bytes of eight.
_INSIDE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def spans(buf: np.ndarray, offsets: np.ndarray, word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' byte ranges; words first[i] to first[i + 1] - 1 are text i's. No word crosses texts.

    The bytes are searched in pieces, so that a long text costs the words' places alone.
    """
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(buf), PIECE):
        b = min(len(buf), a + PIECE)
        inside = word[buf[a:b]]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[0] = a > 0 and word[buf[a - 1]]
        after[-1] = b < len(buf) and word[buf[b]]
        cuts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        before[cuts[cuts < b - a]] = False
        after[cuts[cuts > 0] - 1] = False
        starts.append(np.flatnonzero(inside & ~before) + a)
        ends.append(np.flatnonzero(inside & ~after) + a + 1)
    starts = np.concatenate(starts)
    return starts, np.concatenate(ends), np.searchsorted(starts, offsets)


#: Bytes of a range from which it is hashed on its own.
LONG_RANGE = 256
_LOWER_TABLE = ASCII_LOWER.tobytes()


def _long_hash(buf: np.ndarray, start: int, end: int, lower: bool) -> int:
    name = hashlib.blake2b(digest_size=8)
    for k in range(start, end, SEGMENT):
        part = buf[k : min(k + SEGMENT, end)].tobytes()
        name.update(part.translate(_LOWER_TABLE) if lower else part)
    return int.from_bytes(name.digest(), "little")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; ``lower``: as if A-Z were lower-cased.

    Eight bytes of all ranges at a time go through a bijective mixer, so no two ranges that differ in eight bytes alone
    share a hash, and no algebraic pattern of bytes does. Long ranges are hashed by blake2b, a segment at a time.
    """
    out, sizes, i = np.empty(len(starts), np.uint64), ends - starts, 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + SEGMENT, "right")))
        if sizes[i] > max(SEGMENT, LONG_RANGE):
            out[i] = _long_hash(buf, at, int(ends[i]), lower)
            i += 1
            continue
        own = buf[at : int(ends[j - 1])]
        padded = np.concatenate((ASCII_LOWER[own] if lower else own, np.zeros(8, np.uint8)))
        eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        size, which = sizes[i:j], np.arange(i, j)
        h = mix(size.astype(np.uint64) * _SPREAD + _MIX1)
        place, left, long_ = starts[i:j] - at, size, size > LONG_RANGE
        for k in np.flatnonzero(long_).tolist():
            out[i + k] = _long_hash(buf, int(starts[i + k]), int(ends[i + k]), lower)
        keep = ~long_
        while keep.any():
            if not keep.all():
                which, h, place, left = which[keep], h[keep], place[keep], left[keep]
            inside = _INSIDE[np.minimum(left, 8)]
            h = mix((h ^ (eights[place] & inside)) + _SPREAD)
            keep = left > 8
            done = ~keep
            out[which[done]] = h[done]
            place, left = place + 8, left - 8
        i = j
    return out


def exact_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The set of ``width``-word shingles of each text as sorted numbers, which are equal where the words are: no hashes.

    A-Z are lower-cased, ASCII white space parts words. Words are numbered over all texts, and so are runs of words; the
    whole sequence of a text of fewer words has a number below 0. Equal texts are read once.
    """
    known: dict[bytes, int] = defaultdict(itertools.count().__next__)
    short: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
    place = {text: k for k, text in enumerate(dict.fromkeys(texts))}
    ids = [np.array(list(map(known.__getitem__, text.lower().split())), np.int64) for text in place]
    first = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
    flat, m = np.concatenate([*ids, np.zeros(0, np.int64)]), len(known)
    runs, top = flat[: max(0, len(flat) - width + 1)], m
    for k in range(1, width):
        if top * m > 1 << 62:
            named, runs = np.unique(runs, return_inverse=True)
            top = len(named)
        runs, top = runs * m + flat[k : k + len(runs)], top * m
    sets = []
    for i, own in enumerate(ids):
        if len(own) >= width:
            sets.append(np.unique(runs[first[i] : first[i + 1] - width + 1]))
        else:
            sets.append(np.array([-short[own.tobytes()]] if len(own) else [], np.int64))
    return [sets[place[text]] for text in texts]


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): distinct ``width``-word shingles of each text, sorted within it.

    A text of fewer words, but not none, has its whole sequence as its one shingle; one without words has none.
    """
    factors = mix(np.arange(1, width + 2, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    n = np.diff(first)
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        whole += words[k : k + len(whole)] * factors[k]
    whole = mix(whole)
    out, sizes = [], np.zeros(len(n), np.int64)
    for i, (a, k) in enumerate(zip(first[:-1].tolist(), n.tolist())):
        if k >= width:
            own = np.sort(whole[a : a + k - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif k:
            own = mix((words[a : a + k] * factors[:k]).sum(keepdims=True, dtype=np.uint64) + factors[width] * np.uint64(k))
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE):
    """The batch in slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    offsets = utf8(batch.column(batch.schema.get_field_index(column)))[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def thrifty(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task that returns freed memory to the system at its end: workers live on, idle, between stages."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass
