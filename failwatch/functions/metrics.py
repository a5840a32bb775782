"""Numeric expressions: clipping, scoring and confusion measures."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from failwatch import settings as S


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value, leaving null as null (least/greatest would skip it)."""
    return F.when(
        value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high))
    )


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def metric_points(gc_jump: Column) -> Column:
    """Points for high metrics plus the garbage-collection jump."""
    parts = [
        F.when(F.col(c) > limit, points).otherwise(0) for c, limit, points in S.METRIC_POINTS
    ]
    parts.append(F.when(gc_jump > S.GC_JUMP_ABOVE, S.GC_JUMP_POINTS).otherwise(0))
    return reduce(add, parts)


def is_failure(label: str) -> Column:
    return F.coalesce(F.col(label) == "FAILURE", F.lit(False))


def confusion(truth: Column, predicted: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn over boolean columns."""
    return [
        F.count_if(truth & predicted).alias("tp"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
        F.count_if(~truth & ~predicted).alias("tn"),
    ]


def ratio(part: Column, whole: Column) -> Column:
    """Division that gives 0 on an empty denominator."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def precision() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f1() -> Column:
    return ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
