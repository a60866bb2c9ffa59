"""Bounded edit distance and link predicates as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded_distance(a: Column, b: Column, limit: int) -> Column:
    """Levenshtein distance in code points, or -1 if it is above the limit."""
    return F.levenshtein(a, b, limit)


def within(a: Column, b: Column, limit: int) -> Column:
    """The cheap length test comes first."""
    return (F.abs(F.length(a) - F.length(b)) <= limit) & (bounded_distance(a, b, limit) >= 0)


def linked(left: Sequence[Column], right: Sequence[Column], thresholds: Sequence[int], total: int) -> Column:
    """Every attribute within its threshold, and all together within the total."""
    limits = [min(t, total) for t in thresholds]
    each = [within(a, b, t) for a, b, t in zip(left, right, limits, strict=True)]
    distances = [bounded_distance(a, b, t) for a, b, t in zip(left, right, limits, strict=True)]
    close = reduce(lambda x, y: x & y, each)
    return close & (reduce(lambda x, y: x + y, distances) <= total) if len(distances) > 1 else close


def value_linked(a: Column, b: Column, total: int) -> Column:
    """The predicate for single values: only the total counts."""
    return within(a, b, total)
