"""A table of documents with everything that can go wrong, and the driver's smallest tables."""

import random

SF = "/root/testdata/sf0.001"
WORDS = "the of stone bridge river light and under cycle track north field a in harbour quiet morning paper glass engine valley".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents() -> list[tuple]:
    base, long_ = prose(1, 120), prose(2, 30_000)
    near = base.split()
    near[5], near[60] = "changed", "words"
    rows = [
        (1, base),
        (2, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "word"),
        (8, "WORD"),
        (9, long_),
        (10, long_ + " tail"),
        (11, "élan Ünder ’quoted’ — 日本語 text"),
        (12, "!!! ??? 123"),
        (13, "Licensed under the Apache License, Version 2.0.\n" + prose(3, 50)),
        (None, prose(4, 40)),
        (14, prose(5, 80) + " " + prose(77, 14)),
        (15, "<|endoftext|> don't STOP!! 12³ ½"),
        (16, "x" * 70_000),
    ]
    return rows + [(100 + i, prose(1000 + i, 20 + i % 90)) for i in range(60)]


def table(spark, rows=None):
    """With extra columns whose names the operators use inside."""
    rows = documents() if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, score double, part int, length long, band int, shard int"
    return spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else "fr", "s", len(t or ""), 1, "k", 0.5, 1, 2, 3, 4) for d, t in rows], schema)
