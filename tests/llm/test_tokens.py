import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pedalspark.llm import packing, tokenfiles, tokens
from pedalspark.llm.cluster import table_path
from pedalspark.llm.tokens import default_path, word_bpe

from .fixtures import documents, prose, table


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aB 'stréÉ.,!0²\n\x1c\x85\xa0<|>’", max_size=60))
def test_words_as_the_library(text):
    from tokenizers import Tokenizer

    bpe = word_bpe(default_path())
    column = [text, "two words", None, "", text + " end", "naïve été"]
    for end in (None, 7):
        ids, at = bpe.encode(pa.array(column, pa.string()), end)
        for i, x in enumerate(column):
            assert ids[at[i] : at[i + 1]].tolist() == bpe.tokenizer.encode(x or "", add_special_tokens=False).ids + [7] * (end == 7)
    assert Tokenizer


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 64)
    monkeypatch.setattr(tokens.pieces, "__defaults__", (64,))
    bpe = word_bpe(default_path())
    for text in (prose(4, 200), "x" * 300 + " " + prose(5, 30), "y" * 500, "日本 " * 60, prose(6, 20) + " <|endoftext|> " + prose(7, 30), "été " * 40 + "’" * 90):
        assert bpe.encode(pa.array(["a", text]))[0].tolist() == bpe.tokenizer.encode("a", add_special_tokens=False).ids + bpe.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files(tmp_path):
    """A file of another kind is left to the library."""
    file = json.load(open(default_path()))
    file["normalizer"] = None
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(file))
    bpe = tokens.WordBpe(str(path))
    assert not bpe.known and tokens.WordBpe(default_path()).known
    text = "Cased WORDS don't Merge"
    assert bpe.encode(pa.array([text]))[0].tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark, tokenizer):
    rows = packing.pack(table(spark)).collect()
    expected = Counter()
    for doc, text in documents():
        ids = ids_of(tokenizer, text, 1)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            expected[doc, piece, start, len(own), crc(own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 2
    assert packing.pack(table(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=25))
def test_plan_fills_each_place_once(histogram):
    capacity, bins = 50, defaultdict(list)
    ranks = Counter()
    for length, first, at, each, offset in packing.plan(histogram, capacity):
        assert first == ranks[length]
        n = min((r[1] for r in packing.plan(histogram, capacity) if r[0] == length and r[1] > first), default=histogram[length]) - first
        ranks[length] += n
        for k in range(n):
            bins[at + k // each].append((offset + k % each * length, length))
    assert ranks == Counter(histogram)
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
        assert sum(3 * length > capacity for _, length in own) <= 2


def test_token_files(spark, tokenizer):
    folder = table_path(spark, "tokens")
    tokenfiles.write(table(spark), folder, block_tokens=5000, shards=3)
    rows = sorted(tokenfiles.read(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    docs = sorted(documents(), key=lambda d: (d[0] is not None, d[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in docs]
    at = 0
    for r, (_, text) in zip(rows, docs):
        ids = ids_of(tokenizer, text, 2)
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), crc(ids), ids)
        at += len(ids)
    assert [x.tolist() for x in tokenfiles.lookup(spark, folder, 2)] == [ids_of(tokenizer, documents()[1][1], 2)] * 2
    assert tokenfiles.round_trip(table(spark, [])).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3) | st.just(49407), max_size=400), st.sampled_from([0, 60_000]))
def test_repair_round_trip(ids, shift):
    ids = np.array(ids, np.uint32) + shift
    symbols, base, left, right, lengths = tokenfiles.repair(ids, least=2)
    assert tokenfiles.expand(symbols, base, left, right, lengths).tolist() == ids.tolist()
    block = tokenfiles.Block(tokenfiles.to_payload(ids, [5, None], [len(ids) // 2, len(ids) - len(ids) // 2]))
    assert block.docs == [5, None]
    for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2)):
        assert block.ids(a, b).tolist() == ids[a:b].tolist()


def test_repair_compresses():
    ids = np.tile(np.arange(50, dtype=np.uint32), 100)
    assert len(tokenfiles.repair(ids)[0]) < 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=600), st.integers(2, 8))
def test_repair_ends_when_no_pair_is_frequent(ids, least):
    symbols, *_ = tokenfiles.repair(np.array(ids, np.uint32), least)
    times, last = Counter(), {}
    for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist())):
        if last.get(pair) != i - 1:  # overlapping occurrences count once
            times[pair] += 1
            last[pair] = i
    assert max(times.values(), default=0) < least


def test_repair_of_more_symbols_than_16_bits():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 65_000, 3000).astype(np.uint32)
    ids = np.concatenate([ids] * 3)
    symbols, base, left, right, lengths = tokenfiles.repair(ids, 2)
    assert base + len(left) > 1 << 16 and len(symbols) < 10
    assert (tokenfiles.expand(symbols, base, left, right, lengths) == ids).all()
