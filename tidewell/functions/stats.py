"""Aggregate expressions and scalar scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(yes: Column, of: Column) -> Column:
    """Share of rows with yes among those with either; 0 without any."""
    return F.count_if(yes) / F.greatest(F.count_if(yes | of), F.lit(1))


def sum_if(c: Column, cond: Column) -> Column:
    return F.sum(F.when(cond, c))


def percentile_linear(c: str, p: float) -> Column:
    return F.percentile(c, F.lit(p))


def percentile_rank(c: str, p: float) -> Column:
    """Nearest rank: the value at place ceil(p n)."""
    return F.expr(f"percentile_disc({p}) within group (order by {c})")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def order_quality(missing: Column, ambiguous: Column, fields: int = 4) -> tuple[Column, Column, Column]:
    """Completeness, clarity and overall of a structured record."""
    complete = (fields - missing) / F.lit(float(fields))
    clear = F.greatest(F.lit(0.2), 1 - 0.15 * ambiguous)
    return complete, clear, 0.45 * complete + 0.25 * clear + 0.30


def bucket(c: Column) -> Column:
    """A stable number in [0, 1] from the first 32 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)
