"""Byte-level BPE by halves and joins against the library's own encode and decode."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pedalspark.llm import bytebpe

from .fixtures import documents, table

PARTS = [" ", "a", "b", "'s", "'", "re", " the", "!", "=" * 7, "<|endoftext|>", "\n", "1", "é", "日本", "😀", "xxxxx", "    ", "'r", "don't", "<|", " ", "\t"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bytebpe.default_path())


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.sampled_from([4, 9, 33, 100]), st.sampled_from([2, 256]), st.sampled_from([1, 16]))
def test_halves_join_to_the_whole(parts, leaf, long_word, window):
    text, bpe, library = "".join(parts), bytebpe.byte_bpe(bytebpe.default_path()), bytebpe.byte_bpe(bytebpe.default_path()).tokenizer
    old = bytebpe.LONG_WORD, bytebpe.WINDOW
    bytebpe.LONG_WORD, bytebpe.WINDOW = long_word, window
    try:
        cuts = bpe.cuts(text, leaf)
        ids, heads = bpe.joined([bpe.leaf(x) for x in cuts])
    finally:
        bytebpe.LONG_WORD, bytebpe.WINDOW = old
    assert "".join(cuts) == text and ids.tolist() == ids_of(library, text)
    assert (heads == bpe.leaf(text)[1]).all() and bpe.decode(ids.tobytes()) == text


def test_one_word_without_end(library):
    """Windows of ids around the joins are enough, and nothing else of the word is encoded again."""
    bpe, rng = bytebpe.ByteBpe(bytebpe.default_path()), random.Random(3)
    for alphabet, again in (("ACGT", 0.2), ("=", 40), ("abcdefghij", 0.2)):
        text = "".join(rng.choice(alphabet) for _ in range(60_000))
        leaves = [bpe.leaf(x) for x in bpe.cuts(text, 4096)]
        seen, plain = [0], bpe.of_bytes
        bpe.of_bytes = lambda word: (seen.__setitem__(0, seen[0] + len(word)), plain(word))[1]
        ids = bpe.joined(leaves)[0]
        del bpe.of_bytes
        assert ids.tolist() == ids_of(library, text) and seen[0] <= again * len(text)


def test_every_latin_character(library):
    bpe = bytebpe.byte_bpe(bytebpe.default_path())
    for c in map(chr, range(256)):
        for text in (f"a{c}b", f"1{c}1", f" {c}{c} x", f"!{c}'s", f"  {c}"):
            assert np.frombuffer(bpe.ids(text), "<u4").tolist() == ids_of(library, text)


def test_decode_of_any_ids(library):
    bpe, rng = bytebpe.byte_bpe(bytebpe.default_path()), random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert bpe.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [bytebpe.LEAF, 50])
def test_round_trip(spark, library, leaf):
    rows = documents()
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.round_trip(table(spark, rows), leaf=leaf).collect())
    ids = [(d, t or "", np.array(ids_of(library, t or ""), "<u4")) for d, t in rows]
    assert got == sorted((d or -1, len(i), hashlib.sha256(i.tobytes()).hexdigest(), hashlib.sha256(library.decode(i.tolist(), skip_special_tokens=False).encode()).hexdigest()) for d, t, i in ids)
    assert bytebpe.round_trip(table(spark, [])).count() == 0
