"""Inputs on which operators once went wrong: patterns that defeat hashes, tables without texts or ids, wrapped licences."""

import hashlib
import random
import textwrap
from pathlib import Path

import numpy as np
import pytest

from pedalspark.llm import langid, licences, lmscore, neardup, textbytes

from .fixtures import prose, table


def thue_morse(n: int, flip: int) -> str:
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [8, 255, 256, 512, 1024, 4096])
def test_words_that_defeat_polynomial_hashes(n):
    data = f"{thue_morse(n, 0)} {thue_morse(n, 1)} {thue_morse(n, 0).upper()}".encode()
    buf = np.frombuffer(data, np.uint8)
    starts, ends, _ = textbytes.spans(buf, np.array([0, len(data)]))
    a, b, c = textbytes.word_hashes(buf, starts, ends, lower=True).tolist()
    assert a == c != b


def test_texts_of_one_such_word_are_not_linked(spark):
    rows = [(1, thue_morse(1024, 0)), (2, thue_morse(1024, 1)), (3, thue_morse(1024, 0).upper())]
    got = {r.doc_id: r.component_id for r in neardup.classes(table(spark, rows), 2).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_links_are_confirmed_on_words(monkeypatch):
    """Without a hash of any word; equal numbers mean equal runs of words, over all texts of a call."""
    monkeypatch.setattr(textbytes, "word_hashes", None)
    rng = random.Random(4)
    for _ in range(60):
        texts = [" ".join(rng.choice(["a", "B", "b", "cc", "D"]) for _ in range(rng.randrange(30))) for _ in range(6)] + [""]
        width = rng.choice([1, 2, 5])
        sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in (t.lower().split() for t in texts)]
        got = [set(x.tolist()) for x in textbytes.exact_sets([t.encode() for t in texts], width)]
        for a, x in zip(sets, got):
            for b, y in zip(sets, got):
                assert (len(a), len(a & b)) == (len(x), len(x & y))


def test_runs_of_many_different_words():
    """So many words that runs are numbered anew on the way."""
    texts = [prose(k, 40_000) + " " + " ".join(f"w{k % 2}{i}" for i in range(30_000)) for k in (1, 2, 3)]
    got = textbytes.exact_sets([t.encode() for t in texts], 5)
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in sets]
    assert len(np.intersect1d(got[0], got[2])) == len(sets[0] & sets[2]) > 0


CASES = {
    "only empty texts": [(i, "", "en") for i in range(50)] + [(99, None, "fr")],
    "no letters": [(i, "12 !?", "en" if i % 2 else "fr") for i in range(40)],
    "one repeated id": [(7, prose(i, 9), "en" if i % 2 else "fr") for i in range(90)],
    "null ids": [(None, prose(i, 9), "en" if i % 2 else "fr") for i in range(90)],
    "one language": [(i, prose(i, 9), "en") for i in range(30)],
    "one hot copy": [(i, prose(i, 9), "fr") for i in range(30)] + [(5, "the same", "en")] * 60 + [(6, "other words", "en")],
    "no language": [(i, "words", None) for i in range(9)],
    "no rows": [],
}


@pytest.mark.parametrize("name", CASES)
def test_language_sample(spark, name, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 5)
    docs = spark.createDataFrame(CASES[name], "doc_id long, text string, lang string")
    rows = langid.sample(docs, per_language=20)
    by_lang = {lang: [p for x, p in rows if x == lang] for lang in {x for x, _ in rows}}
    assert all(1 <= len(p) <= 20 for p in by_lang.values())
    assert set(by_lang) == {lang for _, text, lang in CASES[name] if text and lang}
    if name == "one hot copy":
        assert len(by_lang["en"]) == 2
    assert len(langid.sample(docs, per_language=20, most=3)) <= 3
    net = langid.fit(docs, 20)
    assert (net is None) == (not rows)
    got = langid.predict(docs, net).collect()
    assert len(got) == len(CASES[name])
    assert all(r.lang_pred in (*by_lang, "und") and 0 <= r.score <= 1 for r in got)


def wrapped(text: str):
    """As wholes, paragraph by paragraph, and line by line, with margins of comments."""
    for width in range(50, 101, 5):
        for margin in ("", "    ", " * ", "# "):
            yield "\n\n".join("\n".join(margin + x for x in textwrap.wrap(" ".join(p.split()), width)) for p in text.split("\n\n"))
        yield "\n".join("\n".join(textwrap.wrap(line, width)) for line in text.split("\n"))


def test_licences_however_they_are_wrapped(spark):
    heads = ["", "Copyright (c) 2019-2021 A. Person\n\n", "MIT License\n\nCopyright 2020 by Somebody. All rights reserved.\n\n", "© 2020 A. Person\n\n"]
    rows = [(name, heads[0 if "Licen" in text[:20] or k % 2 else k % 4 // 2] + x) for name, text in licences.known_texts() for k, x in enumerate(wrapped(text))]
    got = licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    missed = [(rows[r.doc_id][0], rows[r.doc_id][1][:60]) for r in got if r.license_id != rows[r.doc_id][0]]
    assert len(got) == len(rows) and not missed


def test_spellings_and_lists(spark):
    bsd = licences.TEXTS["BSD-2-Clause"][0]
    rows = [
        (1, bsd.replace("1. ", "* ").replace("2. ", "* ")),
        (2, bsd.replace("1. ", "(a) ").replace("2. ", "(b) ")),
        (3, licences.TEXTS["Zlib"][0].replace("acknowledgment", "acknowledgement")),
        (4, licences.TEXTS["MIT"][0].replace("NONINFRINGEMENT", "NON-\nINFRINGEMENT").replace("sublicense", "sub-license")),
        (5, bsd.replace("this list of conditions", "that list of conditions")),
        (6, "Copyright notice\nof one line"),
    ]
    got = {r.doc_id: r.license_id for r in licences.scan(table(spark, rows)).collect()}
    assert got == {1: "BSD-2-Clause", 2: "BSD-2-Clause", 3: "Zlib", 4: "MIT", 5: None, 6: None}


def test_lists_of_any_length(spark):
    rows = [
        (1, "a. " * 30_000),
        (2, "Some words, " + "b)\n" * 30_000 + "and more"),
        (3, "".join(f"{i % 100}. " for i in range(30_000)) + "Released under the MIT License"),
    ]
    sha = lambda form: hashlib.sha256(form.encode()).hexdigest()
    got = {r.doc_id: (r.digest, r.license_id, r.notices) for r in licences.scan(table(spark, rows)).collect()}
    assert got == {1: (None, None, ""), 2: (sha("some words and more"), None, ""), 3: (sha("released under the mit license"), None, "MIT")}


SHARED = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not SHARED.is_dir(), reason="the system keeps no licence texts")
def test_long_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, (SHARED / f).read_text()) for i, f in enumerate(files) if (SHARED / f).is_file()]
    got = {r.doc_id: r.license_id for r in licences.scan(table(spark, rows)).collect()}
    assert got == {i: name for i, name in enumerate(files.values()) if i in got} and len(got) == len(rows)


def test_histories_in_two_bytes():
    common = np.array([1, 2, 50, 90, 1 << 63], np.uint64)
    before = np.array([50, 3, 1 << 63, 1, 7, 90], np.uint64)
    codes, rest = lmscore.coded(before, common)
    assert len(codes) == 12 and len(rest) == 16
    assert lmscore.decoded(np.frombuffer(codes, "<u2"), np.frombuffer(rest, "<u8"), common).tolist() == before.tolist()
