"""Measures of ranked results and of sets, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean4(value: Column) -> Column:
    """Mean to four places, 0 of nothing."""
    return F.coalesce(F.round(F.avg(value), 4), F.lit(0.0))


def share_true(flag: Column) -> Column:
    """Share of rows where the flag is true, null counting as false."""
    return F.coalesce(F.round(F.avg(F.when(flag, 1.0).otherwise(0.0)), 4), F.lit(0.0))


def share_of_known(flag: Column) -> Column:
    """Share of true among the rows where the flag is known, null where it never is."""
    return F.round(F.avg(flag.cast("int")), 4)


def nearest_rank(value: Column, percent: int) -> Column:
    """The value at the rank nearest to the percentile, halves to even; 0 of nothing.

    The sorted values of one group are held at once: groups are the variants of a report.
    """
    values = F.sort_array(F.collect_list(value))
    at = F.bround(F.lit(percent / 100.0) * (F.size(values) - 1), 0).cast("int")
    return F.when(F.size(values) > 0, F.round(F.get(values, at), 3)).otherwise(F.lit(0.0))


def ideal_gain(relevant: Column, k: int) -> Column:
    n = F.least(relevant, F.lit(k)).cast("int")
    gains = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.lit(1.0) / F.log2(i + F.lit(1.0)))
    return F.when(n > 0, F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements by the smaller of two sets."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def duplicate_score(a: Column, b: Column) -> Column:
    return F.greatest(jaccard(a, b), overlap(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, null where one is all zero."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when(norm > 0, product(a, b) / norm)
