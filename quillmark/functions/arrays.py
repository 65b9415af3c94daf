"""Order-preserving list arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_list(value: Column, is_array: bool) -> Column:
    """A scalar or list as a list without null and blank entries."""
    items = value if is_array else F.array(value)
    return F.coalesce(F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "")), F.array())


def union(*lists: Column, most: int | None = None) -> Column:
    """First occurrences over all lists, in order, ``most`` at most."""
    joined = F.array_distinct(F.concat(*[F.coalesce(x, F.array()) for x in lists]))
    return F.slice(joined, 1, most) if most else joined


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common entries by the smaller set's size; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    all_ = F.size(x) + F.size(y) - both
    return F.when(all_ > 0, both / all_).otherwise(F.lit(0.0))


def missing_extra(want: Column, have: Column) -> tuple[Column, Column]:
    return F.array_except(want, have), F.array_except(have, want)
