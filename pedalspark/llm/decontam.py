"""Benchmark decontamination by windows of words, in DataFrame operations only.

A-Z are lower-cased; words are runs of ASCII letters, digits and characters beyond ASCII. A benchmark item's windows are
its runs of ``width`` words (all of its words, if they are fewer). The hashes of the distinct windows are broadcast, if
their number is within ``BROADCAST_WINDOWS``, else joined by shuffle; every hit is verified word by word.

A document is named by the MD5 of its id and text, so that nothing hangs on the order of rows; repeated rows have equal
results.

Defined cases: null, empty and wordless texts have no words and no hits, as items they have no windows; a null item_id
is left out; repeated items count once; extra columns are ignored; an empty table of documents gives an empty result, an
empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # of lower-cased text
PARTS = "([0-9A-Za-z\\x{80}-\\x{10FFFF}]+|[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+)"  # of the text itself: words and what stands between
BROADCAST_WINDOWS = 2_000_000
WIDTH = 10
SEGMENT = 1 << 16  # words of a text that are hashed at once


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def once(column: Column) -> Column:
    """``column`` as the one row of a generator, so that the optimizer can't move its evaluation into a lambda."""
    return F.explode(F.array(column))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def window_hashes(of: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; none if there are fewer words.

    Words are hashed once. Hashes of runs of 2, 4, 8 ... words come from those of their halves, so that a window costs a few
    hashes of two numbers, whatever its size.
    """
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    after = lambda a, k: F.slice(a, k + 1, F.size(a))

    def joined(runs: dict[int, Column]) -> Column:
        n = max(runs)
        if 2 * n <= size:
            return let(pair(runs[n], after(runs[n], n)), lambda x: joined({**runs, 2 * n: x}))
        out = runs[n]
        for k in sorted((k for k in runs if k < n and size & k), reverse=True):
            out, n = pair(out, after(runs[k], n)), n + k
        return F.slice(out, 1, F.greatest(F.size(runs[1]) - size + 1, F.lit(0)))

    return let(F.transform(of, lambda w: F.xxhash64(w)), lambda x: joined({1: x}))


def name() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, size, hash, window) of every item, without repetition."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", once(words(F.col("text"))).alias("words")).filter(F.size("words") > 0)
    found = None
    for size in range(1, width + 1):
        own = items.filter(F.size("words") == size if size < width else F.size("words") >= width)
        rows = own.select("item_id", "words", F.posexplode(window_hashes(F.col("words"), size)).alias("i", "hash"))
        rows = rows.select("item_id", F.lit(size).alias("size"), "hash", F.slice("words", F.col("i") + 1, F.lit(size)).alias("window"))
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def segments(docs: DataFrame, columns: list[str], size: int) -> DataFrame:
    """(columns, n_words, at, words): the words of each text; a long one in segments that overlap by ``size`` - 1 words, from word ``at``."""
    n = F.size("words")
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(SEGMENT)), lambda i: F.struct(i.alias("at"), F.slice("words", i + 1, F.lit(SEGMENT + size - 1)).alias("words")))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("words")))
    return docs.select(*columns, once(words(F.col("text"))).alias("words")).select(*columns, n.alias("n_words"), F.explode(F.when(n <= SEGMENT, whole).otherwise(cut)).alias("s")).select(*columns, "n_words", "s.at", "s.words")


def hits(docs: DataFrame, items: DataFrame, with_rows: bool = False) -> DataFrame:
    """(key, start, size, hash): the places in each document where a window of ``items`` occurs. ``items`` must be stored.

    ``with_rows``: also doc_id and n_words, and a row with ``first`` for every document, hit or not: both come from one pass.
    """
    known = stored(items.groupBy("size", "hash").agg(F.collect_set("window").alias("windows")), "known")
    sizes = sorted(r.size for r in known.select("size").distinct().collect())  # WIDTH rows at most
    few = known.count() <= BROADCAST_WINDOWS
    rows = docs.select("doc_id", "text", name().alias("key"))
    columns, out = ["key", "doc_id"] if with_rows else ["key"], None
    kept = [*columns, *(["n_words", "first"] if with_rows else []), "start", "size", "hash"]
    for size in sizes:
        first = with_rows and size == sizes[0]
        own = known.filter(F.col("size") == size).select("hash", "windows")
        explode = F.posexplode_outer if first else F.posexplode
        places = segments(rows, columns, size).select("*", window_hashes(F.col("words"), size).alias("hashes"))
        places = places.select(*columns, "n_words", "at", "words", explode("hashes").alias("i", "hash"))
        window = F.slice("words", F.col("i") + 1, F.lit(size))
        if few:
            at = places.join(F.broadcast(own), "hash", "left" if first else "inner")
        else:  # both sides are shuffled by hash, each place with its own words alone
            at = places.withColumn("window", window).drop("words").join(own.hint("shuffle_hash"), "hash", "left" if first else "inner")
            window = F.col("window")
        hit = F.coalesce(F.array_contains("windows", window), F.lit(False))
        at = at.withColumn("first", (F.col("at") == 0) & (F.coalesce("i", F.lit(0)) == 0) & F.lit(first)).withColumn("hit", hit).filter("first OR hit")
        at = at.withColumns({"start": F.col("at") + F.col("i"), "size": F.lit(size), "hash": F.when(F.col("hit"), F.col("hash"))}).select(kept)
        out = at if out is None else out.unionByName(at)
    if out is None:  # nothing to find
        empty = segments(rows, columns, 1).filter("at = 0").withColumns({"first": F.lit(True), "start": F.lit(0), "size": F.lit(0), "hash": F.lit(None).cast("long")}).select(kept)
        out = empty if with_rows else empty.limit(0)
    return out


def spans(found: DataFrame) -> DataFrame:
    """(key, start, end): the words hit, each once, as runs that don't overlap."""
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.select("key", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    return rows.withColumn("start", F.greatest("start", reach)).filter("start < end")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    items = stored(item_windows(benchmark, width), "windows")
    both = stored(hits(docs, items, with_rows=True), "hits")
    found = both.filter("hash IS NOT NULL").select("key", "start", "size", "hash")
    covered = spans(found).groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    by_window = items.select("size", "hash", "item_id")
    if items.count() <= BROADCAST_WINDOWS:
        by_window = F.broadcast(by_window)
    of_items = found.select("key", "size", "hash").distinct().join(by_window, ["size", "hash"]).select("key", F.col("item_id").cast("string").alias("item")).distinct()
    named_items = of_items.groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    result = covered.join(named_items, "key")
    rows = both.filter("first").select("key", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.join(result, "key", "left").select("doc_id", "n_words", n("n_hit").alias("n_hit"), n("n_items").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n("n_hit") > 0).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the words hit and what stands between them."""
    found = stored(hits(docs, stored(item_windows(benchmark, width), "windows")), "hits")
    if remove == "documents":
        rows = docs.withColumn("_key", name())
        return rows.join(found.select(F.col("key").alias("_key")).distinct().hint("merge"), "_key", "left_anti").select(docs.columns)
    if remove != "spans":
        raise ValueError(remove)
    cut = spans(found).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut")).withColumnRenamed("key", "_key")
    rows = docs.withColumn("_key", name())
    parts = F.regexp_extract_all("text", F.lit(PARTS), 1)
    rows = rows.join(cut, "_key", "left").withColumn("_parts", F.when(F.col("_cut").isNotNull(), parts))
    lead = F.when(F.col("_parts")[0].rlike("^[0-9A-Za-z\\x{80}-\\x{10FFFF}]"), 0).otherwise(1)

    def stays(part: Column, i: Column) -> Column:
        word = F.floor((i - lead) / 2)  # a part between words belongs to the word before it
        is_word = F.pmod(i - lead, F.lit(2)) == 0
        return ~F.exists("_cut", lambda s: (word >= s["start"]) & F.when(is_word, word < s["end"]).otherwise(word < s["end"] - 1))

    text = F.when(F.col("_cut").isNotNull(), F.array_join(F.filter("_parts", stays), "")).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(F.col("_cut").isNotNull(), F.length(text)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return rows.withColumns(changed).select(docs.columns)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
REPORT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
places AS (SELECT item_id, w, least({WIDTH}, len(w)) AS size, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM places),
sizes AS (SELECT DISTINCT size FROM known),
runs AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
found AS (SELECT DISTINCT rid, i, size, item_id FROM (SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM runs) JOIN known USING (size, g)),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
