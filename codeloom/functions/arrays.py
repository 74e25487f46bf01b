"""Array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs_of(items: Column, a: str = "item_a", b: str = "item_b") -> Column:
    """All pairs a < b of a sorted array of distinct items."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias(a), y.alias(b)))))


def sorted_set(c: Column) -> Column:
    """Sorted distinct non-null entries; a null array gives an empty one."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())))
