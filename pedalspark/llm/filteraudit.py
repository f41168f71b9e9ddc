"""How filters of documents act together: what each removes at each step of every order.

A document fails some of five filters; its failures are five bits. A fixed table of 32 sets of failures by 120 orders
tells the step that removes it. Tasks count documents by part, failures and label, look these up in the table, and add
up removals by part, order, step and label with ``np.bincount``; the tasks' arrays are summed by Spark. All other
figures follow from these sums and the numbers of documents that fail a filter at all, or it alone.

A copy is a text that a smaller doc_id has, anywhere in the table. Each text's smallest doc_id comes from digests,
aggregated before they are shuffled; rows meet it by digest and doc_id, so that copies of one text, however many, are
dealt out over tasks.

Defined cases: a null text is empty, a null lang is the empty string; a row without a doc_id copies nothing and is
copied by nothing, and has no label; repeated rows count each, and rows of one doc_id and text are no copies of each
other; a document is good or toxic if any of its labels says so; a text of any length is read in pieces; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import PIECE, text_slices, thrifty, utf8

FILTERS = "ABCDE"
ORDERS = list(itertools.permutations(range(5)))
#: STEPS[failures, order]: the step, from 0, that removes a document with these failures; 5 if none does.
STEPS = np.array([[next((s for s, f in enumerate(order) if failures >> f & 1), 5) for order in ORDERS] for failures in range(32)])

#: Bounds of the filters: words, distinct words in a hundred, capitals in a hundred code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_CAPITALS, _FOLLOWING, _SYMBOLS = bytes(range(65, 91)), bytes(range(0x80, 0xC0)), b"#$%&*|"
_SPACE = b" \t\n\v\f\r"


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of at least PIECE bytes that end at white space."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def failures(text: bytes) -> int:
    """The bits of A to D that ``text`` fails."""
    words, distinct, capitals, points, symbols = 0, set(), 0, 0, False
    for piece in _pieces(text):
        own = piece.split()  # at the ASCII white space
        words += len(own)
        distinct.update(own)
        capitals += len(piece) - len(piece.translate(None, _CAPITALS))
        points += len(piece.translate(None, _FOLLOWING))
        symbols = symbols or len(piece.translate(None, _SYMBOLS)) < len(piece)
    return (words < LEAST_WORDS) + 2 * (100 * len(distinct) < LEAST_DISTINCT * words) + 4 * (100 * capitals > MOST_CAPITALS * points) + 8 * symbols


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failures, label) of every row; the label is 1 for good and 2 for toxic documents, 3 for both."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                buf, at = utf8(part.column(3))
                own = [failures(buf[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(own, pa.int32())], ["doc_id", "part", "digest", "failures"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    rows = rows.mapInArrow(thrifty(run), "doc_id long, part string, digest binary, failures int")
    firsts = docs.filter("doc_id IS NOT NULL").groupBy(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")).agg(F.min(F.col("doc_id").cast("long")).alias("doc_id")).withColumn("first", F.lit(True))
    is_ = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0)))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((is_("quality") + 2 * is_("toxic")).alias("label"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    found = rows.join(firsts.hint("merge"), ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("failures") + F.when(copy, 16).otherwise(0)).alias("failures"))
    return found.join(known, "doc_id", "left").select("part", "failures", F.coalesce("label", F.lit(0)).alias("label"))


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by part, failures and label, then removals by part, order, step and label, of one task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        which = coded.indices.to_numpy() * 128 + batch.column(1).to_numpy() * 4 + batch.column(2).to_numpy()
        own = np.bincount(which, minlength=128 * len(coded.dictionary)).reshape(-1, 128)
        for part, n in zip(coded.dictionary.to_pylist(), own):
            sums[part] = sums.get(part, 0) + n
    place = np.arange(len(ORDERS))[None, :, None] * 24 + STEPS[:, :, None] * 4 + np.arange(4)  # [failures, order, label]
    for part, n in sums.items():
        removed = np.bincount(place.ravel(), np.broadcast_to(n.reshape(32, 1, 4), place.shape).ravel(), len(ORDERS) * 24).astype(np.int64).reshape(len(ORDERS), 6, 4)
        n = n.reshape(32, 4).sum(1)
        bit = np.arange(32)[:, None] >> np.arange(5) & 1
        fails, alone = n @ bit, n[1 << np.arange(5)]
        at = np.array(ORDERS)  # the filter of each order's steps
        good, toxic = removed[:, :5, 1] + removed[:, :5, 3], removed[:, :5, 2] + removed[:, :5, 3]
        columns = [np.repeat(np.arange(len(ORDERS)), 5), np.tile(np.arange(5), len(ORDERS)), np.full(5 * len(ORDERS), n.sum()), removed[:, :5].sum(2).ravel(), fails[at].ravel(), alone[at].ravel(), good.ravel(), toxic.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.string()), *(pa.array(c.astype(np.int64)) for c in columns)], _NAMES)


_NAMES = ["part", "order", "step", "docs", "removed", "fails", "unique_fails", "good_lost", "toxic_lost"]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark: SparkSession = docs.sparkSession
    rows = flagged(docs, labels).mapInArrow(_counts, "part string, " + ", ".join(f"{c} long" for c in _NAMES[1:]))
    sums = rows.groupBy("part", "order", "step").agg(*(F.sum(c).alias(c) for c in _NAMES[3:]))
    names = ["".join(FILTERS[f] for f in order) for order in ORDERS]
    named = sums.withColumn("filter_order", F.element_at(F.array(*map(F.lit, names)), (F.col("order") + 1).cast("int")))
    named = named.withColumn("filter", F.substring("filter_order", 1, 5).substr((F.col("step") + 1).cast("int"), F.lit(1)))
    # 600 rows a part from here on
    steps = F.collect_list(F.struct("order", "filter_order", "step", "filter", "docs", "removed", "fails", "unique_fails", "good_lost", "toxic_lost")).alias("steps")
    each = named.groupBy("part").agg(steps).select("part", "steps", F.explode("steps").alias("s"))
    total = lambda keep: F.aggregate(F.filter("steps", keep), F.lit(0).cast("long"), lambda a, x: a + x["removed"])
    gone = total(lambda x: (x["order"] == F.col("s.order")) & (x["step"] <= F.col("s.step")))
    shapley = total(lambda x: x["filter"] == F.col("s.filter"))
    return each.select(
        "part", "s.filter_order", (F.col("s.step") + 1).cast("int").alias("step"), (F.col("s.docs") - gone).alias("kept"), "s.removed",
        (F.col("s.fails") - F.col("s.removed")).alias("redundant"), "s.unique_fails", "s.good_lost", "s.toxic_lost", shapley.alias("shapley"),
    )


_WORDS_SQL = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
AUDIT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS_SQL} AS words, min(doc_id) OVER (PARTITION BY text) AS smallest FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > smallest, false) AS e
          FROM w LEFT JOIN l USING (doc_id)),
f AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter FROM orders, range(1, 6) g(step)),
of AS (SELECT part, filter_order, step, filter, n, good, toxic, a::INT + b::INT + c::INT + d::INT + e::INT AS failed,
       contains(concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')), filter) AS hit,
       len(regexp_replace(substr(filter_order, 1, step - 1), '[^' || concat('x', if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) || ']', '', 'g')) > 0 AS earlier
       FROM f, steps),
r AS (SELECT part, filter_order, step, filter, sum(n) AS docs, sum(n) FILTER (hit AND NOT earlier) AS removed, sum(n) FILTER (hit AND earlier) AS redundant, sum(n) FILTER (hit AND failed = 1) AS unique_fails,
      sum(good) FILTER (hit AND NOT earlier) AS good_lost, sum(toxic) FILTER (hit AND NOT earlier) AS toxic_lost FROM of GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(docs - sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
