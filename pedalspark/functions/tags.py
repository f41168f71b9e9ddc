"""Predicates and values of street tags. A missing tag makes every predicate false, never null."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every tag that a rule looks at; tables without one get it as null.
EDGE_TAGS = {
    "highway": "string",
    "bicycle": "string",
    "access": "string",
    "footway": "string",
    "service": "string",
    "motor_vehicle": "string",
    "shoulder:access:bicycle": "string",
    "lanes": "string",
    "maxspeed": "string",
    "oneway": "boolean",
    "width": "double",
    "est_width": "double",
    "length": "double",
    "slope_class": "string",
    "context": "string",
}


def with_tags(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in EDGE_TAGS.items() if c not in df.columns})


def tag(name: str) -> Column:
    return F.col(f"`{name}`")


def is_(name: str, *values: str) -> Column:
    return F.coalesce(tag(name).isin(*values), F.lit(False))


def not_(name: str, value: str) -> Column:
    """True where the tag is missing or another."""
    return ~is_(name, value)


def family(df: DataFrame, prefix: str) -> list[str]:
    """The columns of a tag family, such as cycleway, cycleway:left."""
    return [c for c in df.columns if c.startswith(prefix)]


def any_is(columns: Iterable[str], *values: str) -> Column:
    return functools.reduce(lambda a, b: a | b, (is_(c, *values) for c in columns), F.lit(False))


def parts(df: DataFrame, name: str) -> Column:
    """The values of a tag that may be a list or text with semicolons, as an array."""
    kind = dict(df.dtypes)[name]
    return tag(name) if kind.startswith("array") else F.split(tag(name).cast("string"), ";")


def first_match(rules: Iterable[tuple[str, Column]], default: str | None = None) -> Column:
    """The code of the first rule that holds, in the order given."""
    out = None
    for code, holds in rules:
        out = F.when(holds, code) if out is None else out.when(holds, code)
    return out.otherwise(F.lit(default))
