import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pedalspark.llm import decontam, langid, licences, lmscore, neardup, quality, sharding
from pedalspark.llm.queries import fold
from pedalspark.llm.textbytes import spans, utf8

from .fixtures import SF, documents, prose, table


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, width=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text("aBé \n\t.日", max_size=12), max_size=6))
def test_words_on_bytes(texts):
    buf, offsets = utf8(pa.array(texts, pa.string()))
    starts, ends, first = spans(buf, offsets)
    for i, text in enumerate(texts):
        own = [bytes(buf[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_classes(rows, width=5):
    groups, sets = brute_groups(rows, width)
    named = {g: min((rows[i][0] for i in own if rows[i][0] is not None), default=None) for g, own in groups.items()}
    return Counter((rows[i][0], len(sets[i]), named[g], rows[i][0] is not None and rows[i][0] == named[g]) for g, own in groups.items() for i in own)


def brute_kept(rows, width=5):
    """The rows that deduplication leaves."""
    groups, _ = brute_groups(rows, width)
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
    return sorted((min((rows[i] for i in own), key=order) for own in groups.values()), key=order)


def brute_groups(rows, width):
    sets, parent = [shingle_set(t, width) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return groups, sets


def copies(n, edits):
    """Near copies of one text: a chain and a cloud about the threshold."""
    base = prose(9, 100).split()
    out = []
    for i in range(n):
        own = list(base)
        for k in range(edits * (i % 5) // 2):
            own[(i * 7 + k * 13) % 100] = f"edit{i}x{k}"
        out.append((1000 + i, " ".join(own)))
    return out


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SALTED", 8)
    for rows in (documents(), copies(60, 6)):
        for width in (2, 5):
            got = neardup.classes(table(spark, rows), width).collect()
            assert Counter(tuple(r) for r in got) == brute_classes(rows, width)
    assert neardup.classes(table(spark, [])).collect() == []


def test_deduplication(spark):
    """Also rows without an id, different texts under one id, repeated rows and rows without words."""
    twin = prose(8, 60)
    rows = documents() + [(None, twin), (None, twin), (None, prose(1, 120)), (300, prose(30, 50)), (300, prose(31, 50)), (None, ""), (5, "")]
    kept = neardup.deduplicated(table(spark, rows))
    assert kept.columns == table(spark).columns
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest(), r[1] is None)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=order) == sorted(brute_kept(rows), key=order)
    assert neardup.deduplicated(table(spark, [])).collect() == []


def test_registers_merge_and_estimate():
    a, b = (pa.array([prose(s, 3000)]) for s in (1, 2))
    both = pa.array([a[0].as_py() + " " + b[0].as_py()])
    (ra, rb, rc) = (neardup.registers(*neardup.text_sets(x, 1)) for x in (a, b, both))
    assert (neardup.merged(ra, rb) == rc).all()
    sets = [neardup.text_sets(x, 1)[0] for x in (a, b)]
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs(neardup.estimate(ra, rb, *(np.array([len(s)]) for s in sets))[0] - true) < 0.15


ITEMS = [(1, prose(77, 14)), (2, prose(77, 14)), (3, "word"), (4, None), (5, ""), (None, prose(5, 20)), (7, prose(1, 200))]


def windows(text, size):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return w, [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]


def brute_report(rows, items):
    known = {}
    for item, text in items:
        n = len(windows(text, 1)[0])
        if item is not None and n:
            for g in windows(text, min(10, n))[1]:
                known.setdefault(g, set()).add(str(item))
    out = Counter()
    for doc, text in rows:
        hit, found = set(), set()
        for size in {len(g) for g in known}:
            for i, g in enumerate(windows(text, size)[1]):
                if g in known:
                    hit |= set(range(i, i + size))
                    found |= known[g]
        out[doc, len(windows(text, 1)[0]), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_decontamination(spark):
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, key string, size int")
    got = decontam.report(table(spark), bench).collect()
    expected = brute_report(documents(), ITEMS)
    assert Counter(tuple(r) for r in got) == expected
    assert sum(n for k, n in expected.items() if k[-1]) >= 4
    clean = decontam.cleaned(table(spark), bench)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k in expected.elements() if not k[-1])
    assert all(not r.contaminated for r in decontam.report(table(spark), bench.limit(0)).collect())
    assert decontam.report(table(spark, []), bench).collect() == []
    for r in decontam.cleaned(table(spark), bench, remove="spans").collect():
        assert not any(k[-1] for k in brute_report([(r.doc_id, r.text)], ITEMS)), r.doc_id
        assert r.n_chars == len(r.text or "")


def test_decontamination_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert Counter(tuple(r) for r in decontam.report(table(spark), bench).collect()) == brute_report(documents(), ITEMS)


def test_licences(spark):
    mit = licences.TEXTS["MIT"][0]
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + mit),
        (2, mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace("\n", "  \n ")),
        (3, mit + " More."),
        (4, "text\nReleased under the MIT License.\nThis work is licensed under the GNU General Public Licence, version 3\nend"),
        (5, None),
        (6, " .. "),
        (6, " .. "),
    ]
    got = {r.doc_id: r for r in licences.scan(table(spark, rows)).collect()}
    assert [got[i].license_id for i in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert got[4].notices == "GPL-3.0,MIT" and got[1].notices == ""
    assert got[5].digest is None and got[6].digest is None
    assert licences.scan(table(spark, rows)).count() == 7 and licences.scan(table(spark, [])).count() == 0


def test_sharding(spark):
    rows = [tuple(r) for r in sharding.shards(table(spark)).collect()]
    assert Counter((r[0], r[1], r[2]) for r in rows) == Counter((d, 16 + len((t or "").encode()), __import__("zlib").crc32((t or "").encode())) for d, t in documents())
    slots = {}
    for r in rows:
        assert r[3] == "key" and 0 <= r[4] < 40 and r[6] in (r[4], 40)
        slots.setdefault(r[4], []).append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r[0], r[4]) for r in rows}) == len({r[0] for r in rows})
    assert sharding.shards(table(spark, [])).collect() == []
    n = spark.range(20_000).withColumn("text", F.lit("")).withColumnRenamed("id", "doc_id")
    by = {r.shard: r.n for r in sharding.shards(n, 4, [1.0, 1.0, 2.0, 0.0]).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert 3 not in by and abs(by[2] - 10_000) < 500 and abs(by[0] - 5000) < 400


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.languages(docs, fold(4, 2)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 30
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    odd = {r.doc_id: r for r in langid.languages(table(spark), fold(4, 2)).collect()}
    assert [odd[i].lang_pred for i in (4, 5, 6, 12)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[9].lang_pred != "und"
    assert {r.lang_pred for r in langid.languages(table(spark).withColumn("lang", F.lit(None).cast("string")), fold(4, 2)).collect()} == {"und"}
    assert langid.languages(table(spark, []), fold(4, 2)).collect() == []


def test_whole_text_is_seen():
    """Windows cover every run of bytes as wide as the widest filter."""
    text = prose(3, 400)
    buf, offsets = utf8(pa.array([text, "", "ab"]))
    first, own = langid.window_places(offsets)
    windows = langid.windows_of(buf, offsets, first, own, 0, len(own))
    raw = text.encode()
    runs = {bytes(w[i : i + 4]) for w in windows[: first[1]] for i in range(langid.WINDOW - 3)}
    assert all(raw[i : i + 4] in runs for i in range(len(raw) - 3))
    assert np.diff(first).tolist()[1:] == [0, 1]


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scores(docs, labels, fold(3, 1)).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    odd = quality.scores(table(spark), labels, fold(3, 1)).collect()
    assert len(odd) == len(documents()) and all(r.score is not None and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    none = quality.scores(table(spark), labels.limit(0), fold(3, 1)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.scores(table(spark, []), labels, fold(3, 1)).collect() == []


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9]), np.ones(5))
    assert np.allclose(y, [0.1, 1.1 / 3, 0.9]) and np.allclose(x, [0, 2, 4])


def test_lm_scores(spark):
    rows = documents()
    target = spark.createDataFrame([(d,) for d in range(100, 130)], "doc_id long")
    got = Counter((r.doc_id, r.n_tokens, *(None if x is None else round(x, 4) for x in (r.target_loss, r.background_loss, r.score))) for r in lmscore.scores(table(spark), target).collect())
    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t)) for _, t in rows]
    # all words fit in the vocabulary, so ids are the words themselves; size counts the places, used or not
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for (doc, _), w in zip(rows, words):
        for k in (0, 1):
            if k or (doc is not None and 100 <= doc < 130):
                uni[k].update(w)
                bi[k].update(zip([None, *w], w))
    totals = [sum(u.values()) for u in uni]
    scale, v, mu = [1.0, totals[0] / totals[1]], lmscore.VOCABULARY, lmscore.MU
    before = [Counter(), Counter()]
    for k in (0, 1):
        for (a, _), n in bi[k].items():
            before[k][a] += n
    assert len(uni[1]) < v

    def loss(k, w):
        p = lambda x: (uni[k][x] * scale[k] + 1) / (totals[k] * scale[k] + v)
        return sum(-np.log((bi[k][a, b] * scale[k] + mu * p(b)) / (before[k][a] * scale[k] + mu)) for a, b in zip([None, *w], w)) / len(w)

    expected = Counter()
    for (doc, _), w in zip(rows, words):
        expected[(doc, len(w), *((round(loss(0, w), 4), round(loss(1, w), 4), round(loss(0, w) - loss(1, w), 4)) if w else (None,) * 3))] += 1
    close = lambda a, b: a[:2] == b[:2] and all((x is None) == (y is None) and (x is None or abs(x - y) < 2e-3) for x, y in zip(a[2:], b[2:]))
    order = lambda c: sorted(c.elements(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert all(close(a, b) for a, b in zip(order(got), order(expected), strict=True))
    assert lmscore.scores(table(spark, []), target).collect() == []


def test_lm_scores_know_every_word(spark, monkeypatch):
    rows = [(i, f"rare{i} of w{i % 50} the x{i % 7} the y{i % 3}" + f" own{i}" * (i % 2)) for i in range(3000)] + [(5000, None), (0, "rare0 of"), (0, "rare0 of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(0, 3000, 3)], "doc_id long")
    monkeypatch.setattr(lmscore, "PART", 1 << 11)
    uni, bi, before = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for doc, text in rows:
        w = (text or "").split()
        for k in (0, 1):
            if k or (doc < 3000 and doc % 3 == 0):
                uni[k].update(w)
                bi[k].update(zip([None, *w], w))
                before[k].update([None, *w][: len(w)])
    totals, v, mu = [sum(u.values()) for u in uni], len(uni[1]), lmscore.MU
    scale = [1.0, totals[0] / totals[1]]
    assert v > lmscore.VOCABULARY
    p = lambda k, x: (uni[k][x] * scale[k] + 1) / (totals[k] * scale[k] + v)
    loss = lambda k, w: sum(-np.log((bi[k][a, b] * scale[k] + mu * p(k, b)) / (before[k][a] * scale[k] + mu)) for a, b in zip([None, *w], w)) / len(w)
    expected = sorted((doc, len(t.split()), loss(0, t.split()), loss(1, t.split())) for doc, t in rows if t)
    got = lmscore.scores(docs, target).collect()
    assert len(got) == len(rows) and [r.target_loss for r in got if r.doc_id == 5000] == [None]
    np.testing.assert_allclose(sorted((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got if r.n_tokens), expected, rtol=1e-5)


def test_whole_licences_and_statements(spark):
    mit = licences.TEXTS["MIT"][0]
    rows = [
        (1, open("/usr/share/common-licenses/Apache-2.0").read()),
        (2, open("/usr/share/common-licenses/GPL-3").read()),
        (3, "Copyright 2020 A. Person. Licensed under the MIT License.\nmore"),
        (4, "Copyright (c) 2020 A. Person " + mit.replace("\n", " ")),
        (5, "MIT License Copyright (c) 2020 A. Person " + mit.replace("\n", " ")),
        (6, "Copyright (c) 2020 A. Person " + mit.replace("\n", " ") + " More."),
    ]
    got = {r.doc_id: (r.license_id, r.notices) for r in licences.scan(table(spark, rows)).collect()}
    assert got == {1: ("Apache-2.0", ""), 2: ("GPL-3.0", ""), 3: (None, "MIT"), 4: ("MIT", ""), 5: ("MIT", ""), 6: (None, "")}
