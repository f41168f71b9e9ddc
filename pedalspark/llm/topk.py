"""Exact top-k search by inner product over vector-approximation files.

Components are whole numbers, ``floor(scale * x)``. The approximation file keeps one of 64 cells for each component
(cells by quantiles of a bounded sample, bounded outside by the true extremes). A first scan reads cells alone and bounds
every score; the kth best lower bound of a query rules out all vectors whose upper bound is below it. Exact vectors are
then read in the order of their bounds: the first ``FIRST`` of each query, and after them only those whose bound is not
below the kth score found, until the kth result is certain.

Queries and vectors are dealt in blocks of bounded size, and a task sees one block of each. Equal vectors are one entry
with its k + 1 smallest ids, the only ones that can be results, so copies cost nothing.

Defined cases: null and empty vectors, those with null or non-finite components and rows with a null id take part in nothing;
vectors are compared with those of their own length; every row is a vector and, if its id asks, a query of its own, so a
repeated id is a candidate of its other rows and a repeated query returns its results once for each row; ties go to the
smaller id; fewer than k others: all of them; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import stored

CELLS, SAMPLE, FIRST = 64, 20_000, 32
QUERY_BLOCK, VECTOR_BLOCK = 512, 8192
RESULT = "query_id long, rank int, vec_id long, score long"


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, code): the usable vectors as arrays of whole numbers."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    code = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).filter(usable).select("vec_id", code.alias("code"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(node, code, ids, n): equal vectors together, with their k + 1 smallest ids; a hot vector's ids are ranked in salted groups first."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    own = Window.partitionBy("code", "salt").orderBy("vec_id")
    few = salted.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= k + 1)
    grouped = few.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    return grouped.select(F.xxhash64("code", F.col("ids")[0]).alias("node"), "code", "ids", F.size("code").alias("dim"))


def cell_bounds(nodes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (edges, inner) where cell c of component j holds edges[j, c] to edges[j, c + 1]; whole numbers."""
    n = nodes.count()
    components = nodes.select("node", "dim", F.posexplode("code").alias("j", "x"))
    extremes = components.groupBy("dim", "j").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    sampled = components.filter(F.pmod(F.col("node"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, n)) * float(1 << 30))
    inner = sampled.groupBy("dim", "j").agg(F.percentile_approx("x", [c / CELLS for c in range(1, CELLS)], 1000).alias("q")).collect()
    quantiles = {(r.dim, r.j): r.q for r in inner}
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in extremes}:
        own = sorted((r.j, r.lo, r.hi) for r in extremes if r.dim == dim)
        cuts = np.array([np.clip(sorted(quantiles.get((dim, j)) or [lo] * (CELLS - 1)), lo, hi) for j, lo, hi in own], np.int64)
        low = np.hstack((np.array([[lo] for _, lo, _ in own], np.int64), cuts + 1))  # cell c: above cut c - 1, up to cut c
        high = np.hstack((cuts, np.array([[hi] for *_, hi in own], np.int64)))
        out[dim] = cuts, np.stack((np.minimum(low, high), high))
    return out


def approximations(nodes: DataFrame, bounds: dict) -> DataFrame:
    """(node, dim, cells): a byte for each component."""

    def run(batches):
        for batch in batches:
            dims, codes = batch.column(1).to_numpy(), batch.column(2)
            cells = [b""] * batch.num_rows
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = codes.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                cuts = bounds[int(dim)][0]
                c = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(dim)], 1).astype(np.uint8) if dim else np.zeros((len(rows), 0), np.uint8)
                for r, own in zip(rows, c):
                    cells[r] = own.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], ["node", "dim", "cells"])

    return nodes.select("node", "dim", "code").mapInArrow(run, "node long, dim int, cells binary")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """RESULT: for each vector whose id ``every`` divides, the k others of the largest inner product, ties to the smaller id."""
    rows = whole(vectors, scale)
    nodes = stored(distinct_vectors(rows, k), "vectors")
    bounds = cell_bounds(nodes)
    cells = stored(approximations(nodes, bounds), "cells")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "code").agg(F.count("*").alias("times"))
    queries = stored(asked.join(nodes, "code").select("times", F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "code").alias("query"), "code", "dim", F.col("node").alias("own"), (F.size("ids") == 1).alias("alone")), "queries")
    query_blocks, vector_blocks = -(-queries.count() // QUERY_BLOCK) or 1, -(-cells.count() // VECTOR_BLOCK) or 1
    dealt = lambda df, key, n, m, mine, other: df.withColumn(mine, F.pmod(F.xxhash64(key, F.lit(3)), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>")))
    left = dealt(queries.select("query", "own", "alone", "code", "dim"), "query", query_blocks, vector_blocks, "qb", "vb")
    right = dealt(cells, "node", vector_blocks, query_blocks, "vb", "qb")

    def bound(q: pa.Table, v: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64())})
        if not q.num_rows or not v.num_rows:
            return empty
        dim = q.column("dim")[0].as_py()
        low, high = bounds[dim][1]
        x = np.array(q.column("code").combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, dim)
        c = np.frombuffer(b"".join(v.column("cells").to_pylist()), np.uint8).reshape(-1, dim)
        at = np.arange(dim)
        lo, hi, up, down = low[at, c].astype(float), high[at, c].astype(float), np.maximum(x, 0), np.minimum(x, 0)
        least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
        node = v.column("node").to_numpy()
        none = (q.column("own").to_numpy()[:, None] == node[None, :]) & q.column("alone").to_numpy(zero_copy_only=False)[:, None]
        least[none] = most[none] = -np.inf
        cut = np.partition(least, -k, 1)[:, -k] if len(node) > k else np.full(len(x), -np.inf)
        i, j = np.nonzero((most >= cut[:, None]) & ~none)
        return pa.table({"query": q.column("query").to_numpy()[i], "node": node[j], "low": least[i, j].astype(np.int64), "high": most[i, j].astype(np.int64)})

    keys = ["dim", "qb", "vb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(bound, "query long, node long, low long, high long")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low"))))
    kth = F.min(F.when(F.col("r") <= k, F.col("low"))).over(Window.partitionBy("query"))
    full = F.max("r").over(Window.partitionBy("query")) >= k
    near = ranked.withColumn("kth", F.when(full, kth)).filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("query", "node", "high")
    near = stored(near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("high"), "node"))), "near")

    def read(table: pa.Table) -> pa.Table:
        """One query: exact vectors by descending bound, k at a time, until the kth score is above all bounds left."""
        order = np.argsort(-table.column("high").to_numpy(), kind="stable")
        high = table.column("high").to_numpy()[order]
        q, own = np.array(table.column("code")[0].as_py(), np.int64), table.column("own")[0].as_py()
        query, best = table.column("query_id")[0].as_py(), []
        for i in range(0, len(order), k):
            if len(best) == k and -best[-1][0] > high[i]:
                break
            for at in order[i : i + k].tolist():
                score = int(q @ np.array(table.column("other")[at].as_py(), np.int64))
                ids = list(table.column("ids")[at].as_py())
                if table.column("node")[at].as_py() == own and query in ids:
                    ids.remove(query)
                best += [(-score, vec) for vec in ids]
            best = sorted(best)[:k]
        n, times = len(best), table.column("times")[0].as_py()
        return pa.table({"query": pa.array([table.column("query")[0].as_py()] * n, pa.int64()), "query_id": pa.array([query] * n, pa.int64()), "times": pa.array([times] * n, pa.int64()), "vec_id": pa.array([v for _, v in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.int64())})

    def exact(wanted: DataFrame) -> DataFrame:
        both = wanted.join(nodes.select("node", F.col("code").alias("other"), "ids"), "node").join(queries.select("query", "query_id", "code", "own", "times"), "query")
        return both.groupBy("query").applyInArrow(read, "query long, query_id long, times long, vec_id long, score long")

    first = stored(exact(near.filter(F.col("r") <= FIRST)), "first")
    sure = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    rest = near.filter(F.col("r") > FIRST).join(sure, "query", "left").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).drop("kth")
    ranked = first.unionByName(exact(rest)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    again = ranked.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return again.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
