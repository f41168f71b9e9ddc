"""How the sources of each language differ in their words: distances of sources, and the terms that mark each one.

1. Tasks count terms by language and source, and the documents of a language that hold them, in dictionaries of bounded
   size; Spark adds them up. A language keeps the terms of at least ``LEAST_DOCS`` of its documents.
2. Kept terms are dealt into blocks of about ``TERMS`` for each language, sources into blocks of about ``SOURCES``. Each
   pair of source blocks and each term block is one group: a dense int64 tile of sources by terms, whose rows are
   broadcast against all others. It returns its part of the pairs' sums and a heap of the best terms of each source.
3. Spark sums the partial matrices by pair, and merges the heaps by source.

All values are whole numbers: p = 1 + floor(10^9 (count + 5) / (N + 5 V)), by long division in steps that fit 64 bits.

Defined cases: null text, lang and source are empty strings; texts without terms belong to a group all the same;
repeated rows count each; equal values are ranked by their item's bytes, so no two rows tie; a text of any length is
counted in pieces; extra columns are ignored; an empty table gives an empty result, a language of one source no pairs.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import stored
from .textbytes import PIECE, text_slices, thrifty, utf8

LEAST_DOCS, TOP, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
TERMS, SOURCES = 1024, 128
#: Different terms that a task counts before it passes the counts on.
HELD = 400_000

_TERM = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Lower-cases A-Z; bytes outside terms become blanks.
_CLEAN = bytes((b + 32 if 0x41 <= b < 0x5B else b) if b in _TERM else 0x20 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of ``text``, a piece at a time; pieces end between terms."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            while end < len(text) and text[end] in _TERM:
                end += 1
        yield text[at:end].translate(_CLEAN).split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, texts) in held.items():
                columns = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(n.values(), pa.int64()), pa.array([texts[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for part in text_slices(batch):
                buf, at = utf8(part.column(2))
                for lang, source, i, j in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), at[:-1], at[1:]):
                    n, texts = held[lang, source]
                    own: set[bytes] = set()
                    for terms in _terms(buf[i:j].tobytes()):
                        n.update(terms)
                        own.update(terms)
                    texts.update(own)
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*text).mapInArrow(thrifty(run), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (counts + SMOOTH) / total), exact for totals below 9 * 10^15: three digits at a time."""
    whole, rest = np.divmod(counts.astype(np.int64) + SMOOTH, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def _tile(key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
    """The partial sums of pairs and the best terms of one term block and one pair of source blocks (``sources``: side 0 and 1)."""
    lang, rows = sources["lang"][0].as_py(), sources.to_pylist()
    sides = [sorted((r["source"], r["total"]) for r in rows if r["side"] == k) for k in (0, 1)]
    terms = {t: k for k, t in enumerate(sorted(set(counts["term"].to_pylist())))}
    of_all = np.zeros(len(terms), np.int64)
    tiles, found = [], []
    at = np.array([terms[t] for t in counts["term"].to_pylist()], np.int64)
    of_all[at] = counts["in_lang"].to_numpy()
    for names in sides:
        place = {s: k for k, (s, _) in enumerate(names)}
        tile = np.zeros((len(names), len(terms)), np.int64)
        mine = np.array([place.get(s, -1) for s in counts["source"].to_pylist()], np.int64)
        tile[mine[mine >= 0], at[mine >= 0]] = counts["n"].to_numpy()[mine >= 0]
        found.append(tile)
        tiles.append(shares(tile, np.array([[n] for _, n in names], np.int64).reshape(-1, 1)))
    out: list[tuple] = []
    same = key[2].as_py() == key[3].as_py()
    for i, (source, _) in enumerate(sides[0]):
        sums = np.abs(tiles[1] - tiles[0][i]).sum(1)
        for j, (other, _) in enumerate(sides[1]):
            if source != other:
                out.append((lang, source, "pair", other, int(sums[j])))
                if not same:
                    out.append((lang, other, "pair", source, int(sums[j])))
    if same and len(terms):
        q, names = shares(of_all, rows[0]["lang_total"]), list(terms)
        for i, (source, _) in enumerate(sides[0]):
            more = tiles[0][i] - q
            some = np.flatnonzero((found[0][i] > 0) & (more > 0)).tolist()
            out += [(lang, source, "term", names[t], int(more[t])) for t in heapq.nsmallest(TOP, some, key=lambda t: (-more[t], t))]
    columns = list(zip(*out)) or [[]] * 5
    return pa.table([pa.array(c, pa.string() if k < 4 else pa.int64()) for k, c in enumerate(columns)], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: all ``pair`` rows, and the first ``TOP`` ``term`` rows of each group."""
    counts = stored(term_counts(docs), "terms")
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)
    in_lang = stored(in_lang.select("lang", "term", "in_lang"), "kept")
    kept = stored(counts.join(in_lang, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"), "kept-counts")
    langs = in_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("n_lang"))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    v, zero = F.coalesce("v", F.lit(0)), F.lit(0)
    own = own.select("lang", "source", (F.coalesce("n", zero) + SMOOTH * v).alias("total"), (F.coalesce("n_lang", zero) + SMOOTH * v).alias("lang_total"), F.greatest(F.lit(1), F.ceil(v / TERMS)).alias("blocks"))
    # a total of zero stands where there are no terms, so nothing is divided by it
    sizes = own.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("of_sources"), F.first("blocks").alias("blocks"))
    own = stored(own.drop("blocks").join(sizes, "lang").withColumn("s", F.pmod(F.xxhash64("source"), "of_sources")), "groups")
    every = lambda low, n: F.explode(F.sequence(low, F.col(n) - 1))
    blocked = own.withColumn("b", every(F.lit(0).cast("long"), "blocks"))
    left = blocked.withColumn("t", every(F.col("s"), "of_sources")).select("lang", "b", F.col("s").alias("i"), F.col("t").alias("j"), F.lit(0).alias("side"), "source", "total", "lang_total")
    right = blocked.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), "s"))).select("lang", "b", F.col("t").alias("i"), F.col("s").alias("j"), F.lit(1).alias("side"), "source", "total", "lang_total")
    headers = left.unionByName(right)
    place = kept.join(own.select("lang", "source", "s", "of_sources", "blocks"), ["lang", "source"]).withColumn("b", F.pmod(F.xxhash64("term"), "blocks"))
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("of_sources") - 1)).alias("t")
    place = place.select("lang", "b", "s", "source", "term", "n", "in_lang", met).select("lang", "b", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "source", "term", "n", "in_lang")
    keys = ["lang", "b", "i", "j"]
    parts = headers.groupBy(*keys).cogroup(place.groupBy(*keys)).applyInArrow(lambda key, a, b: _tile(key, b, a), "lang string, source string, part string, item string, value long")
    parts = stored(parts, "tiles")
    sums = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    best = parts.filter("part = 'term'").select("lang", "source", "part", "item", "value", rank).filter(F.col("rank") <= TOP)
    return sums.select("lang", "source", "part", "item", "value", rank).unionByName(best)


_TERMS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
AUDIT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest({_TERMS_SQL}) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
langs AS (SELECT lang, sum(n) AS n, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {UNIT} * CAST(coalesce(c.n, 0) + {SMOOTH} AS HUGEINT) // (g.n + {SMOOTH} * l.v) AS p, 1 + {UNIT} * CAST(k.n + {SMOOTH} AS HUGEINT) // (l.n + {SMOOTH} * l.v) AS q
      FROM g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
