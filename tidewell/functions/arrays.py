"""Arrays and maps: set ratios, coercions, merges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlap(a: Column | str, b: Column | str) -> Column:
    """Share of a's distinct elements that b has; 0 for an empty a."""
    a, b = F.array_distinct(_c(a)), _c(b)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Null if both are empty."""
    a, b = _c(a), _c(b)
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n)


def as_list(x: Column | str) -> Column:
    """Trimmed non-empty strings; null is an empty list."""
    return F.coalesce(F.filter(F.transform(_c(x), lambda s: F.trim(s)), lambda s: s != ""), F.array().cast("array<string>"))


def merge_maps(a: Column | str, b: Column | str) -> Column:
    """The right side wins; null is an empty map."""
    a = F.coalesce(_c(a), F.create_map().cast("map<string,string>"))
    b = _c(b)
    kept = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(kept, b)
