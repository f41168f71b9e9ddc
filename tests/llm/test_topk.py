import math
import random

import pytest

from pedalspark.llm import topk


def brute(rows, every=50, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, c) in enumerate(usable):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(c, d)), i) for m, (i, d) in enumerate(usable) if m != n and len(c) == len(d))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "copies", "odd", "few", "repeated", "tied"])
def test_as_brute_force(spark, kind):
    rng = random.Random(3)
    vector = lambda: [round(rng.gauss(0, 0.2), 3) for _ in range(8)]
    if kind == "spread":
        rows = [(i, vector()) for i in range(400)]
    elif kind == "copies":
        same = vector()
        rows = [(i, same if i % 3 else vector()) for i in range(300)]
    elif kind == "odd":
        rows = [(0, None), (50, [None] * 8), (100, [float("nan")] * 8), (150, [float("inf")] + [0.0] * 7), (None, vector()), (200, [0.1, 0.2]), (250, []), (300, vector()), (301, [0.3, 0.1])] + [(i, vector()) for i in range(302, 330)]
    elif kind == "repeated":
        one = vector()
        rows = [(50, one), (50, one), (50, vector()), (100, vector()), (100, vector()), *((i, vector()) for i in range(1, 90)), (7, one), (7, one)]
    elif kind == "tied":
        rows = [(i, [0.5] * 4 + [0.0] * 4 if i % 2 else [0.0] * 8) for i in range(200)]
    else:
        rows = [(0, vector()), (1, vector()), (50, vector())]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, node int, code int")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
