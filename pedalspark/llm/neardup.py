"""Near-duplicate documents: SetSketch registers, banding, a joint likelihood estimate, and a check on the full sets.

1. One pass over the texts gives each document the size and a 128-bit digest of its shingle set and the set's SetSketch
   registers (exponentially spaced, truncated minima; the registers of a union are the maxima of the parts' registers).
2. Documents of equal sets are one node. Four registers make a band; nodes that share a band's values are candidates.
3. In each bucket every node is compared with the bucket's hub, so that a bucket of any size costs as many pairs as it
   has nodes: first the smallest node, then, where a bucket holds several components, its most central one. Pairs whose
   likelihood estimate is far below the threshold go; the others are confirmed on the full sets of words. In buckets that
   still hold several components, every node outside the largest one meets all nodes of other components, in blocks that
   return links alone, so that no link that matters is left out.
4. Components come from repeated star contraction.

A link of two different sets is missed if they share no band: below 1e-6 at a similarity of 0.8 with 28 bands of 4.
Node ids are 64 bits of the digest.

A bucket or hub may hold a third of all rows: where a key stands in more than ``SALTED`` rows of the larger side of a join,
these rows are dealt over salts and the other side's one row is copied to each (``spread``).

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; repeated rows are copies; a row
with a null doc_id takes part but names a component only in ``deduplicated``, where no other row of it has an id; texts
of any length are read in pieces and compared whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import stored
from .graphs import components
from .textbytes import exact_sets, mix, shingles, spans, text_slices, thrifty, utf8, word_hashes

BANDS, ROWS = 28, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: A pair is checked if its estimate is at most this far below the threshold: over five standard deviations.
SLACK = 0.2
STRAY_BLOCK, MEMBER_BLOCK = 256, 512
SALTED, BROADCAST_KEYS = 512, 1_000_000

_rng = np.random.default_rng(20140)
_A = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)

SKETCH = "doc_id long, text_key binary, n_shingles long, d1 long, d2 long, registers binary"


def text_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the distinct shingles of each text; A-Z are lower-cased, ASCII white space parts words."""
    buf, offsets = utf8(column)
    starts, ends, first = spans(buf, offsets)
    return shingles(word_hashes(buf, starts, ends, lower=True), first, width)


def exact_text_sets(columns: list[pa.Array], width: int) -> list[list[np.ndarray]]:
    """``exact_sets`` of the texts of several columns, numbered together."""
    texts = []
    for column in columns:
        buf, at = utf8(column)
        texts += [buf[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
    sets = exact_sets(texts, width)
    cuts = np.cumsum([0, *map(len, columns)])
    return [sets[i:j] for i, j in zip(cuts, cuts[1:])]


def near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets are as similar as asked; empty ones never are."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common) > 0


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16 [texts, REGISTERS]: 1 - log_b of the minimum of exponential variates, rounded down and truncated.

    The variates are monotone in a uniform hash, so the minimum is taken over the hashes and transformed once.
    """
    out = np.zeros((len(first) - 1, REGISTERS), np.uint16)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    h, at = (hashes >> np.uint64(32)).astype(np.uint32), first[some]
    v = np.empty_like(h)
    for i in range(REGISTERS):
        np.multiply(h, _A[i], out=v)
        np.add(v, _B[i], out=v)
        u = (np.minimum.reduceat(v, at) + 0.5) / 2.0**32
        out[some, i] = np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, TOP + 1)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of most likelihood, of pairs of registers and set sizes (Ertl, 2021), on a grid of 0.01."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * grid), p(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda n, q: np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0.0)
        fit = part(more, up) + part(less, down) + part(same, 1 - up - down)
    fit[(grid > np.minimum(u / v, v / u) + 1e-9)] = -np.inf
    return grid[0, fit.argmax(1)]


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """SKETCH of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                hashes, first = text_sets(part.column(2), width)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(k)), dtype=np.uint64))) for k in (0x1234567, 0x89ABCDEF01)]
                d1, d2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                rows = registers(hashes, first)
                data = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(d1), pa.array(d2), data], [x.split()[0] for x in SKETCH.split(", ")])

    return keyed(docs).mapInArrow(thrifty(run), SKETCH)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))


def banded(nodes: DataFrame) -> DataFrame:
    """(node, band, key): a row for each band of each node's registers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)  # ROWS registers of 16 bits
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "keys"])

    return nodes.select("node", "registers").mapInArrow(thrifty(run), "node long, keys array<long>").select("node", F.posexplode("keys").alias("band", "key"))


def spread(many: DataFrame, one: DataFrame, keys: list[str], sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, which has one row for each value of ``keys``, with hot keys dealt over salts.

    ``sizes`` (keys, n) tells how many rows of ``many`` a key has, if that is known. Hot keys are at most a row in ``SALTED``
    of ``many``; they are broadcast if they are few.
    """
    sizes = sizes if sizes is not None else many.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = stored(sizes.filter(F.col("n") > SALTED).select(*keys, F.ceil(F.col("n") / SALTED).alias("_salts")), "hot")
    n = hot.count()
    if not n:
        return many.join(one, keys, how)
    known = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    left = many.join(known, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("node"), "_salts"), F.lit(0))).drop("_salts")
    right = one.join(known, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, hub) whose sizes allow the similarity and whose estimate comes near it, with the keys of their texts."""
    least = percent / 100 - SLACK

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            near = np.concatenate([estimate(a[i : i + 4096], b[i : i + 4096], *(batch.column(k).to_numpy()[i : i + 4096] for k in (4, 5))) for i in range(0, len(a), 4096)])
            yield batch.select([0, 1, 6, 7, 8, 9]).filter(pa.array(near >= least))

    side = lambda name, k: nodes.select(F.col("node").alias(name), F.col("registers").alias(f"r{k}"), F.col("n_shingles").alias(f"n{k}"), F.col("doc_id").alias(f"doc{k}"), F.col("text_key").alias(f"key{k}"))
    hubs = side("hub", 2).join(pairs.select("hub").distinct(), "hub", "left_semi")
    rows = spread(pairs.join(side("node", 1), "node"), hubs, ["hub"], pairs.groupBy("hub").agg(F.count("*").alias("n"))).filter(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    return rows.select("node", "hub", "r1", "r2", "n1", "n2", "doc1", "key1", "doc2", "key2").mapInArrow(thrifty(run), "node long, hub long, doc1 long, key1 binary, doc2 long, key2 binary")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (node, hub) of ``likely`` whose full shingle sets are as similar as asked; a pair may come more than once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                linked = [near(a, b, percent) for a, b in zip(*exact_text_sets([part.column(2), part.column(3)], width))]
                yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    texts = keyed(docs)
    own = pairs.select("node", "hub", "doc1", "key1")
    hubs = pairs.select("hub", F.col("doc2").alias("doc1"), F.col("key2").alias("key1")).distinct()
    match = lambda r: texts["doc_id"].eqNullSafe(r["doc1"]) & (texts["text_key"] == r["key1"])
    # merge hints: texts cross the network once, at any number of pairs; small inputs have no other plan
    left = texts.join(own.hint("merge"), match(own)).select("node", "hub", "text")
    right = texts.join(hubs.hint("merge"), match(hubs)).groupBy("hub").agg(F.first("text").alias("hub_text"))  # repeated rows of a hub come once
    return spread(left, right, ["hub"], pairs.groupBy("hub").agg(F.count("*").alias("n"))).select("node", "hub", "text", "hub_text").mapInArrow(thrifty(run), "node long, hub long")


def _near(left: pa.Table, right: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a block that may be linked: of different components, near by their registers, and not seen in an earlier band.

    Pairs of two nodes outside the largest component are met from both sides; the smaller node's side counts.
    """
    a, b = (np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS) for t in (left, right))
    of = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
    ka, kb = a.view(np.uint64), b.view(np.uint64)
    n_a, n_b = of(left, "n_shingles"), of(right, "n_shingles")
    band = left.column("band")[0].as_py()
    ok = (of(left, "c")[:, None] != of(right, "c")[None]) & (100 * np.minimum(n_a[:, None], n_b[None]) >= percent * np.maximum(n_a[:, None], n_b[None]))
    ok &= of(right, "major")[None] | (of(left, "node")[:, None] < of(right, "node")[None])
    for earlier in range(band):
        ok &= ka[:, None, earlier] != kb[None, :, earlier]
    i, j = np.nonzero(ok)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 4096):
        at = slice(k, k + 4096)
        keep[at] = estimate(a[i[at]], b[j[at]], n_a[i[at]], n_b[j[at]]) >= percent / 100 - SLACK
    return i[keep], j[keep]


def block_links(members: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): links between the components of each bucket of ``members`` (band, key, node, c).

    Nodes outside a bucket's largest component meet all of its nodes in blocks of bounded size. A first pass over the
    registers tells which nodes of a block have a near partner there; only their texts are fetched for the second, which
    returns links alone. A bucket of q nodes, s of them outside, sends each stray to q / MEMBER_BLOCK blocks and each member
    to s / STRAY_BLOCK: few for what hubs leave over, a square with a small factor where most of a large bucket stays apart.
    """
    sizes = members.groupBy("band", "key", "c").agg(F.count("*").alias("n"))
    info = sizes.groupBy("band", "key").agg(F.max_by("c", F.struct("n", "c")).alias("major_c"), F.sum("n").alias("q"), F.max("n").alias("m"))
    info = stored(info.select("band", "key", "major_c", "q", F.ceil(F.col("q") / MEMBER_BLOCK).alias("mbs"), F.ceil((F.col("q") - F.col("m")) / STRAY_BLOCK).alias("sbs")), "info")
    rows = spread(members, info.drop("q"), ["band", "key"], info.select("band", "key", F.col("q").alias("n"))).withColumn("major", F.col("c") == F.col("major_c")).join(nodes.select("node", "registers", "n_shingles"), "node")
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = rows.filter(~F.col("major")).withColumn("sb", block("sbs")).withColumn("mb", every("mbs"))
    others = rows.withColumn("mb", block("mbs")).withColumn("sb", every("sbs"))
    keys, kept = ["band", "key", "sb", "mb"], ["band", "key", "sb", "mb", "node", "c", "major", "registers", "n_shingles"]
    kinds = "band int, key long, sb long, mb long, node long, c long, major boolean, registers binary, n_shingles long"

    def partners(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.concat_tables([left.slice(0, 0), right.slice(0, 0)]).append_column("stray", pa.array([], pa.bool_()))
        i, j = _near(left, right, percent)
        mine, theirs = left.take(pa.array(np.unique(i))), right.take(pa.array(np.unique(j)))
        return pa.concat_tables([mine, theirs]).append_column("stray", pa.array([True] * mine.num_rows + [False] * theirs.num_rows, pa.bool_()))

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            a, b = exact_text_sets([left.column("text"), right.column("text")], width)
            u, v = left.column("node").to_pylist(), right.column("node").to_pylist()
            for i, j in zip(*(x.tolist() for x in _near(left, right, percent))):
                if near(a[i], b[j], percent):
                    out.append((u[i], v[j]))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    # toDF: fresh columns, as both sides come from one table
    found = strays.select(*kept).groupBy(*keys).cogroup(others.select(*kept).toDF(*kept).groupBy(*keys)).applyInArrow(partners, kinds + ", stray boolean")
    found = stored(found, "near")
    if found.isEmpty():
        return found.select(F.col("node").alias("u"), F.col("c").alias("v"))
    with_text = found.join(texts_of(found.select("node").distinct(), docs, nodes), "node")
    side = lambda stray: with_text.filter(F.col("stray") == stray).select(*kept, "text").toDF(*kept, "text").groupBy(*keys)
    return side(True).cogroup(side(False)).applyInArrow(links, "u long, v long")


def texts_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes of ``wanted``; repeated rows of a representative come once."""
    rep = wanted.join(nodes.select("node", F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key")), "node")
    texts = keyed(docs)
    found = texts.join(rep.hint("merge"), texts["doc_id"].eqNullSafe(rep["rep"]) & (texts["text_key"] == rep["rep_key"])).select("node", "text")
    return found.groupBy("node").agg(F.first("text").alias("text"))


def labelled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the rows' SKETCH, (d1, d2, n_shingles, doc_id, c) of every set: its smallest doc_id and its component)."""
    rows = stored(sketch(docs, width), "sketches")
    first = F.min(F.struct(F.isnull("doc_id").alias("null"), "doc_id", "text_key", "registers")).alias("first")
    grouped = rows.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(first)
    nodes = stored(grouped.select(F.col("d1").alias("node"), "d1", "d2", "n_shingles", "first.doc_id", "first.text_key", "first.registers"), "nodes")
    bands = banded(nodes)
    hubs = stored(bands.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "hubs")
    buckets = stored(spread(bands, hubs, ["band", "key"], hubs).select("band", "key", "node", "hub", "n"), "buckets")
    links = lambda pairs: confirmed(stored(likely(stored(pairs.filter("node <> hub").select("node", "hub").distinct(), "pairs"), nodes, percent), "likely"), docs, width, percent).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    # the smallest node is each bucket's hub, then the node that shares most places with others, then blocks decide
    labels = components(links(buckets))
    open_ = opened(buckets, labels)
    labels = components(links(with_central_hub(open_)).unionByName(stars(labels)))
    open_ = opened(open_, labels)
    if not open_.isEmpty():
        labels = components(block_links(open_, docs, nodes, width, percent).unionByName(stars(labels)))
    named = nodes.join(labels.withColumnRenamed("component", "c"), "node", "left")
    return rows, named.select("d1", "d2", "n_shingles", "doc_id", F.coalesce("c", "node").alias("c"))


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id linked to it, itself included) and kept, for every row."""
    rows, named = labelled(docs, width, percent)
    smallest = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(smallest, "c").select("d1", "d2", "n_shingles", "component_id")
    out = rows.join(of_class, ["d1", "d2", "n_shingles"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def stars(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("u"), F.col("component").alias("v"))


def opened(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, key, node, n, c) of the buckets of three nodes or more in ``members`` that hold several components."""
    named = members.filter("n > 2").select("band", "key", "node", "n").join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    named = stored(named, "named")
    several = stored(named.groupBy("band", "key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).filter("c0 <> c1").select("band", "key", "n"), "several")
    return stored(spread(named, several.drop("n"), ["band", "key"], several), "open")


def with_central_hub(members: DataFrame) -> DataFrame:
    """``members`` with the node of each bucket whose buckets are the largest."""
    weighed = members.join(members.groupBy("node").agg(F.sum("n").alias("weight")), "node")
    hub = F.max_by("node", F.struct("weight", "node")).alias("hub")
    hubs = stored(weighed.groupBy("band", "key").agg(hub, F.count("*").alias("rows")), "hubs")
    return spread(members.drop("hub"), hubs.drop("rows"), ["band", "key"], hubs.withColumnRenamed("rows", "n"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id and, under it, the smallest digest of the text.

    Rows without a doc_id are documents too: they stand last in that order. Rows without shingles are linked with nothing,
    so they all stay. Of repeated rows the one of the smallest hash of its columns stays.
    """
    rows, named = labelled(docs, width, percent)
    own = rows.filter("n_shingles > 0").join(named.select("d1", "d2", "n_shingles", "c"), ["d1", "d2", "n_shingles"])
    order = F.struct(F.isnull("doc_id").alias("null"), "doc_id", "text_key")
    each = own.groupBy("c", "doc_id", "text_key").agg(F.count("*").alias("n"))
    kept = stored(each.groupBy("c").agg(F.min_by(F.struct("doc_id", "text_key", "n"), order).alias("k")).select(F.col("k.doc_id").alias("_kept_id"), F.col("k.text_key").alias("_kept_key"), F.col("k.n").alias("_kept_n")), "kept")
    wordy = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    found = docs.withColumns({"_own_key": F.unhex(F.md5(F.coalesce("text", F.lit("")))), "_own_words": wordy})
    match = found["_own_words"] & found["doc_id"].eqNullSafe(kept["_kept_id"]) & (found["_own_key"] == kept["_kept_key"])
    out = found.join(kept, match, "left").filter(~F.col("_own_words") | F.col("_kept_key").isNotNull())
    if kept.filter("_kept_n > 1").isEmpty():
        return out.select(docs.columns)
    once = out.filter(F.coalesce(F.col("_kept_n"), F.lit(1)) == 1).select(docs.columns)
    order = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    more = out.filter("_kept_n > 1").groupBy("_kept_id", "_kept_key").agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    return once.unionByName(more.select("_row.*"))
