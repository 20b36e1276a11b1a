"""Column expressions shared by the operators: set similarity, vectors, coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two arrays as sets; 0 when both are empty (null: empty)."""
    none = F.array().cast("array<long>")
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, none) for x in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def dot(a: str, b: str) -> Column:
    """Dot product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def as_flag(col: str) -> Column:
    """A text or number as 0/1; null where it can't be read as one."""
    text = F.lower(F.trim(F.col(col).cast("string")))
    return F.when(text.isin("true", "1", "1.0", "yes"), 1).when(text.isin("false", "0", "0.0", "no"), 0)


def as_number(col: str) -> Column:
    """A text as double; null where it isn't one."""
    return F.expr(f"try_cast({col} as double)")


def days(ts: str) -> Column:
    """A timestamp as days since the epoch."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 86400e6


def community_set(col: str) -> Column:
    """``"0;3"`` as array<long>; null and empty texts give the empty array."""
    parts = F.filter(F.split(F.coalesce(F.col(col), F.lit("")), ";"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: x.cast("long"))


def community_text(col: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.col(col))), ";")
