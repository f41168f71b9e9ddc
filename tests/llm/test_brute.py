"""Trained operators and hashes against plain loops."""

import math
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from pedalspark.llm import langid, licences, neardup, quality, sharding, textbytes
from pedalspark.llm.textbytes import utf8

from .fixtures import documents, prose, table


def test_convolution_by_loops():
    """Embedding, filters, maximum and softmax, one byte at a time."""
    net = langid.ByteCnn(["a", "b", "c"], seed=3)
    net.bias[:] = np.random.default_rng(1).normal(0, 0.1, len(net.bias))
    windows = np.frombuffer((prose(1, 90) + "é日").encode()[:512], np.uint8).reshape(2, langid.WINDOW)
    got = net.probabilities(windows)
    for w, p in zip(windows, got):
        hidden, n = [], len(net.bias)
        for f in range(n):
            width = next(wd for k, wd in enumerate(langid.WIDTHS) if f < langid.FILTERS * (k + 1))
            best = -math.inf
            for at in range(langid.WINDOW - langid.WIDTHS[0] + 1):
                best = max(best, sum(float(net.embed[w[at + j]] @ net.filters[j][:, f]) for j in range(width)))
            hidden.append(max(0.0, best + float(net.bias[f])))
        logits = [sum(h * float(net.out[f, c]) for f, h in enumerate(hidden)) + float(net.out_bias[c]) for c in range(3)]
        e = [math.exp(x - max(logits)) for x in logits]
        assert np.allclose(p, [x / sum(e) for x in e], atol=1e-4)


def test_one_step_goes_down_the_gradient():
    """The loss's numeric gradient and the first step of training point the same way (Adam's first step is the gradient's sign)."""
    net = langid.ByteCnn(["a", "b"], seed=4)
    rng = np.random.default_rng(2)
    windows, labels = rng.integers(97, 100, (8, langid.WINDOW)).astype(np.uint8), np.array([0, 1] * 4)
    before = net.out.astype(np.float64).copy()

    def loss():
        p = net.probabilities(windows)
        return -np.log(p[np.arange(len(labels)), labels]).mean()

    # every row is drawn in a step, so the step's gradient is that of the drawn rows: repeat it by the same draws
    draws = np.random.default_rng(6)
    by_class = [np.flatnonzero(labels == c) for c in range(2)]
    pick = np.concatenate([draws.choice(own, -(-langid.BATCH // 2)) for own in by_class])
    windows, labels = windows[pick], labels[pick]
    numeric, h = np.zeros_like(net.out), 1e-2
    for f in range(0, len(net.out), 7):
        for c in range(2):
            old = net.out[f, c]
            net.out[f, c] = old + h
            up = loss()
            net.out[f, c] = old - h
            numeric[f, c] = (up - loss()) / (2 * h)
            net.out[f, c] = old
    again = langid.ByteCnn(["a", "b"], seed=4)
    rng = np.random.default_rng(2)
    again.train(rng.integers(97, 100, (8, langid.WINDOW)).astype(np.uint8), np.array([0, 1] * 4), steps=1)
    step = again.out - before
    clear = np.abs(numeric) > 1e-3
    assert clear.sum() > 3 and (np.sign(step[clear]) == -np.sign(numeric[clear])).all()


def test_mean_over_all_windows():
    net = langid.ByteCnn(["a", "b"], seed=5)
    texts = [prose(i, 10 + 300 * (i % 3)) for i in range(7)] + ["", "ab", None]
    whole = langid.mean_probabilities(net, net.tables(), *utf8(pa.array(texts, pa.string())))
    step = langid.WINDOW - langid.WIDTHS[0] + 1
    for text, p in zip(texts, whole):
        raw = (text or "").encode()
        cuts = [raw[i : i + langid.WINDOW] for i in range(0, max(1, len(raw) - langid.WIDTHS[0] + 1), step)] if raw else []
        own = [net.probabilities(np.frombuffer(c.ljust(langid.WINDOW, b"\0"), np.uint8)[None])[0] for c in cuts]
        assert np.allclose(p, np.mean(own, 0) if own else 0, atol=1e-5)


def test_statistics_by_loops(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 37)
    texts = ["", None, "One two two.\nOne two two.\n", prose(3, 80) + "!?| #$ @é", "x" * 200, "\n\n", "A a A"]
    got = quality.statistics(pa.array(texts, pa.string()))
    for text, row in zip(texts, got):
        raw = (text or "").encode()
        counts = Counter(int(quality._CLASSES[b]) for b in raw)
        assert np.allclose(row[:12], [counts[c] / max(1, len(raw)) for c in range(12)], atol=1e-6)
        words = ["".join(chr(b + 32) if 65 <= b <= 90 else chr(b) for b in w) for w in raw.split()]
        if not words:
            assert not row[12:].any()
            continue
        lengths, lines = [len(w) for w in raw.split()], [x for x in raw.split(b"\n") if x]
        times, pairs, same = Counter(words), Counter(zip(words, words[1:])) or Counter(words), Counter(lines)
        k = len(words)
        expected = (math.log1p(k), np.mean(lengths), np.std(lengths), len(times) / k, max(times.values()) / k, len(pairs) / max(1, k - 1), max(pairs.values()) / k, len(same) / len(lines), math.log1p(len(lines)))
        assert np.allclose(row[12:], expected, atol=1e-5), text


def test_normal_equations_by_loops(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(50, quality.N_STATS)), rng.integers(0, 2, 50).astype(float)
    features = quality.Fourier(x.mean(0), x.std(0))
    x = x.astype(np.float32).astype(np.float64)
    train = spark.createDataFrame([([float(v) for v in row], float(t)) for row, t in zip(x, y)], "stats array<float>, y double")
    gram, moment = quality.normal_equations(train, features)
    expected, own = np.zeros_like(gram), np.zeros_like(moment)
    for row, t in zip(x, y):
        z = [math.cos(sum(min(6, max(-6, (row[j] - features.mean[j]) * features.scale[j])) * features.w[j, f] for j in range(quality.N_STATS)) + features.b[f]) * math.sqrt(2 / quality.FEATURES) for f in range(quality.FEATURES)] + [1.0]
        expected += np.outer(z, z)
        own += t * np.array(z)
    assert np.allclose(gram, expected, atol=1e-6) and np.allclose(moment, own, atol=1e-6)


def test_winning_shard_by_loops(spark):
    def hashed(key, j):
        seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        h = xxhash.xxh64(struct.pack("<i", j), seed=seed).intdigest()
        h -= (h >> 63) << 64
        return (h % (1 << 52) + 0.5) / (1 << 52)

    def winner(key, weights):
        return min((-math.log(hashed(key, j)) / w, j) for j, w in enumerate(weights) if w > 0)[1]

    for weights in ([1.0] * 40, [1.0, 0.0, 2.5, 0.5]):
        more = [*weights, sum(weights) / len(weights)]
        rows = sharding.shards(table(spark), len(weights), weights).collect()
        assert len(rows) == len(documents())
        assert all((r.shard, r.grown_shard) == (winner(r.doc_id, weights), winner(r.doc_id, more)) for r in rows)


def test_every_known_licence_is_found(spark):
    """Each text with changed case, punctuation, copyright lines and spellings; notices whatever stands after "under"."""
    known = licences.known_texts()
    rows = [(i, "Copyright 2021 Somebody\n" + text.upper().replace(",", " ;").replace("LICENSE", "LICENCE").replace(" ", "  ")) for i, (_, text) in enumerate(known)]
    rows += [(1000, "a\nReleased under\tthe MIT License.\nb"), (1001, "Released under: the MIT License."), (1002, "x" * 3_000_000 + " thunder the MIT License")]
    got = {r.doc_id: r for r in licences.scan(table(spark, rows)).collect()}
    assert [got[i].license_id for i in range(len(known))] == [name for name, _ in known]
    assert [got[i].notices for i in (1000, 1001, 1002)] == ["MIT", "MIT", ""]


def test_words_and_hashes_do_not_hang_on_pieces(monkeypatch):
    texts = ["ab cd" * 40, "x" * 100, "", None, "tail " * 9 + "y" * 50]
    column = pa.array(texts, pa.string())

    def hashed():
        buf, offsets = utf8(column)
        starts, ends, first = textbytes.spans(buf, offsets)
        return starts.tolist(), ends.tolist(), first.tolist(), textbytes.word_hashes(buf, starts, ends, lower=True).tolist()

    whole = hashed()
    for piece, segment in ((7, 1 << 18), (1 << 20, 16), (5, 33)):
        monkeypatch.setattr(textbytes, "PIECE", piece)
        monkeypatch.setattr(textbytes, "SEGMENT", segment)
        assert hashed() == whole
    monkeypatch.undo()


def test_one_long_text_and_one_long_word():
    """What the text operators do in Python, on 12 MB in one text and 6 MB in one word."""
    column = pa.array([prose(1, 1000) + " ", "w" * 6_000_000, None], pa.string())
    column = pa.concat_arrays([pa.array([column[0].as_py() * 2000]), column[1:]])
    hashes, first = neardup.text_sets(column, 5)
    assert np.diff(first).tolist()[1:] == [1, 0] and 990 <= first[1] <= 1010
    stats = quality.statistics(column)
    assert np.isfinite(stats).all() and stats[1, 1:13].max() > 0.9
    net = langid.ByteCnn(["a", "b"])
    monkey = langid.mean_probabilities(net, net.tables(), *utf8(column.slice(1)))
    assert np.allclose(monkey.sum(1), [1, 0], atol=1e-3)
