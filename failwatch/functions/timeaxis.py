"""Integer microsecond time axis shared by all ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros(ts: Column) -> Column:
    """TIMESTAMP or TIMESTAMP_NTZ to microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def slot(us: Column, width_us: int) -> Column:
    """Number of the slot of ``width_us`` that holds ``us`` (floors below zero too)."""
    width = F.lit(width_us).cast("bigint")
    return F.call_function("div", us - F.pmod(us, width), width)


def iso(ts: Column) -> Column:
    """ISO 8601 text; the fraction is printed only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))
