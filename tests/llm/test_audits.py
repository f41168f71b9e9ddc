"""The audits of filters and sources against plain loops and DuckDB."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from pedalspark.llm import divergence, filteraudit, queries

from .fixtures import SF, documents, prose, table

duckdb = pytest.importorskip("duckdb")


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_source_divergence"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert rows_of(queries.QUERIES[name](spark, SF)) == sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())


def test_first_failure_table():
    for failures in range(32):
        for k, order in enumerate(itertools.permutations(range(5))):
            assert filteraudit.STEPS[failures, k] == next((s for s, f in enumerate(order) if failures >> f & 1), 5)


def test_filters_by_loops(spark, monkeypatch):
    """Rows of odd tables, counted one document and one order at a time."""
    monkeypatch.setattr(filteraudit, "PIECE", 64)
    rows = documents() + [(900, "A B C " * 50), (901, "A B C " * 50), (901, "A B C " * 50), (902, "x|y"), (None, "A B C " * 50)]
    labels = [(1, 1, 0), (1, 0, 1), (901, 1, 1), (902, None, 1), (None, 1, 1), (5, 0, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filteraudit.audit(table(spark, rows), known).collect()}

    def fails(doc, text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        first = min((d for d, t in rows if d is not None and (t or "") == text), default=None)
        found = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), bool(re.search("[#$%&*|]", text)), doc is not None and doc > first]
        return {f for f, bad in zip("ABCDE", found) if bad}

    docs = [("en" if (d or 0) % 2 else "fr", fails(d, t or ""), any(x == d and q == 1 for x, q, _ in labels if x is not None), any(x == d and y == 1 for x, _, y in labels if x is not None)) for d, t in rows]
    expected, shapley = {}, Counter()
    for part in ("en", "fr"):
        mine = [x for x in docs if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(out)
                expected[part, "".join(order), step] = [len(left), len(out), sum(f in x[1] for x in mine) - len(out), sum(x[1] == {f} for x in mine), sum(x[2] for x in out), sum(x[3] for x in out)]
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in expected.items()} and len(got) == 1200
    assert filteraudit.audit(table(spark, []), known).count() == 0


def test_sources_by_loops(spark, monkeypatch):
    """Small blocks of terms and sources, so that many tiles meet."""
    monkeypatch.setattr(divergence, "PIECE", 32)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "TERMS", 4)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    rows = [(i, "en" if i % 3 else None, f"s{i % 5}" if i % 11 else None, prose(i, 12) + " Élan élan ÉLAN x1y" * (i % 2) if i % 13 else None) for i in range(150)]
    rows += [(900, "xx", "lone", "few words"), (901, "yy", "a", ""), (901, "yy", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").selectExpr("*", "1 AS n", "2 AS term", "3 AS value")
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(upper))) for _, lang, source, text in rows]
    expected = set()
    for lang in {x[0] for x in terms}:
        in_docs = Counter(t for x in terms if x[0] == lang for t in set(x[2]))
        kept = sorted(t for t, n in in_docs.items() if n >= 30)

        def shares(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // total for t in kept}

        of = {s: Counter(t for x in terms if x[:2] == (lang, s) for t in x[2]) for s in {x[1] for x in terms if x[0] == lang}}
        p, q = {s: shares(c) for s, c in of.items()}, shares(Counter(t for x in terms if x[0] == lang for t in x[2]))
        for s in of:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in of if o != s))
            best = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if of[s][t] and p[s][t] > q[t])[:50]
            for part, found in (("pair", pairs), ("term", best)):
                expected |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(docs).collect()]
    assert len(got) == len(expected) and set(got) == expected and any(x[2] == "term" for x in got)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 1, 10**12, 3 * 10**15], np.int64)
    for total in (7 * 10**15, 10**15 + 1, 3 * 10**15 + 5):
        assert divergence.shares(counts, total).tolist() == [1 + 1_000_000_000 * (int(c) + 5) // total for c in counts]
