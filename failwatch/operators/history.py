"""Unlimited look-back for one service that is spread over many tasks.

A service may hold a large share of all rows, so no window here is partitioned by
service alone. Rows are partitioned by (service, time slice); what earlier slices
contribute is reduced to one summary row per slice, combined over the slices of the
service and joined back. The only per-service ordering is over slice summaries.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from failwatch.functions.timeaxis import slot
from failwatch.storage import materialize

KEY = "service_name"
SLICE = "_slice"
SLICE_KEYS = [KEY, SLICE]

# Rows without a time come after all others and are split by source position.
_UNTIMED_BASE = 1 << 50
_UNTIMED_ROWS = 1_000_000
_UNTIMED = 1 << 62


def with_slice(df: DataFrame, width_us: int) -> DataFrame:
    untimed = F.lit(_UNTIMED_BASE) + slot(F.col("seq"), _UNTIMED_ROWS)
    return df.withColumn(SLICE, F.coalesce(slot(F.col("ts_us"), width_us), untimed))


def in_slice() -> WindowSpec:
    """Source order inside one slice, nulls last."""
    return Window.partitionBy(*SLICE_KEYS).orderBy(F.col("ts_us").asc_nulls_last(), "seq")


def earlier_slices() -> WindowSpec:
    """Over slice summaries: all slices of the service before this one."""
    return Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def join_earlier(
    rows: DataFrame,
    summary: list[Column],
    carried: Callable[[WindowSpec], list[Column]],
) -> DataFrame:
    """Attach to each row what all earlier slices of its service add up to."""
    per_slice = rows.where(F.col(KEY).isNotNull()).groupBy(*SLICE_KEYS).agg(*summary)
    carry = per_slice.select(*SLICE_KEYS, *carried(earlier_slices()))
    return rows.join(carry, SLICE_KEYS, "left")


def position(ts: str = "ts_us") -> Column:
    """(time, seq) as one number that orders rows as in the source, untimed rows last.

    A struct would do, but minima and maxima of a number are kept in a hash table,
    those of a struct need the rows sorted by key first.
    """
    at = F.coalesce(F.col(ts), F.lit(_UNTIMED)).cast("decimal(19,0)")
    return at * F.lit(Decimal(1 << 63)).cast("decimal(19,0)") + F.col("seq").cast("decimal(19,0)")


def forward_fill(df: DataFrame, columns: list[str], width_us: int) -> DataFrame:
    """Replace nulls by the last earlier non-null value of the service.

    Runs jobs: rows are filled inside their slice first and written, so that the last row of a
    slice is its summary and no row is compared by position a second time.
    """
    here = in_slice().rowsBetween(Window.unboundedPreceding, 0)
    inside = with_slice(df, width_us).withColumns(
        {c: F.last(c, ignorenulls=True).over(here) for c in columns}
        | {"_end": F.lead(F.lit(True)).over(in_slice()).isNull()}
    )
    rows = materialize(inside, "filled-slices")
    # Written, so that the known size of the summaries lets the rows be joined without a shuffle.
    ends = materialize(rows.where("_end").select(*SLICE_KEYS, *columns), "slice-ends")
    carry = (
        ends.where(F.col(KEY).isNotNull())
        .groupBy(*SLICE_KEYS)
        .agg(*[F.max(c).alias(f"_last_{c}") for c in columns])
        .select(
            *SLICE_KEYS,
            *[F.last(f"_last_{c}", ignorenulls=True).over(earlier_slices()).alias(f"_carry_{c}") for c in columns],
        )
    )
    return rows.join(carry, SLICE_KEYS, "left").withColumns(
        {c: F.when(F.col(KEY).isNotNull(), F.coalesce(c, f"_carry_{c}")) for c in columns}
    ).select(*df.columns)


def running_total(df: DataFrame, amount: Column, name: str, width_us: int) -> DataFrame:
    """Inclusive cumulative sum of ``amount`` per service."""
    rows = with_slice(df, width_us).withColumn("_amount", amount.cast("bigint"))
    totals = join_earlier(
        rows,
        [F.sum("_amount").alias("_slice_total")],
        lambda w: [F.sum("_slice_total").over(w).alias("_before")],
    )
    here = in_slice().rowsBetween(Window.unboundedPreceding, 0)
    return totals.withColumn(
        name, F.coalesce("_before", F.lit(0)) + F.sum("_amount").over(here)
    ).drop(SLICE, "_amount", "_before")


def _tails(rows: DataFrame, value: Column, k: int) -> DataFrame:
    """(service, slice, _history): the last ``k`` values before each slice, oldest first.

    A slice hands on at most ``k`` values, so the previous ``k`` non-empty slices always
    hold enough of them. Short histories are padded with nulls in front.
    """
    newest_first = Window.partitionBy(*SLICE_KEYS).orderBy(
        F.col("ts_us").desc_nulls_first(), F.col("seq").desc()
    )
    tails = (
        rows.where(F.col(KEY).isNotNull())
        .select(*SLICE_KEYS, value.alias("v"), F.row_number().over(newest_first).alias("_back"))
        .where(F.col("_back") <= k)
        .groupBy(*SLICE_KEYS)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), "v"))).alias("_tail"))
    )
    item = tails.schema["_tail"].dataType.elementType
    before = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(-k, -1)
    padded = F.concat(
        F.array_repeat(F.lit(None).cast(item), k), F.flatten(F.collect_list("_tail").over(before))
    )
    return tails.select(*SLICE_KEYS, F.slice(padded, -k, k).alias("_history"))


def previous_rows(df: DataFrame, value: Column, k: int, name: str, width_us: int) -> DataFrame:
    """Add an array with ``value`` of up to ``k`` preceding rows of the service."""
    rows = with_slice(df, width_us).withColumn("_value", value)
    joined = rows.join(_tails(rows, F.col("_value"), k), SLICE_KEYS, "left")
    here = F.collect_list("_value").over(in_slice().rowsBetween(-k, -1))
    inherited = F.coalesce(
        F.transform(F.filter("_history", lambda h: h.isNotNull()), lambda h: h["v"]),
        F.slice(here, 1, 0),
    )
    # The slice of the last k entries; reversed so that short arrays need no special case.
    newest = F.slice(F.reverse(F.concat(inherited, here)), 1, k)
    return joined.withColumn(name, F.reverse(newest)).drop(SLICE, "_history", "_value")


def row_lag(
    df: DataFrame, column: str, rows_back: int, name: str, width_us: int, clamp: bool = False
) -> DataFrame:
    """Value ``rows_back`` rows earlier in the service.

    With ``clamp`` a row that has fewer predecessors gets the oldest value there is
    (its own when it is the first).
    """
    rows = with_slice(df, width_us)
    history = _tails(rows, F.col(column), rows_back)
    joined = rows.join(history, SLICE_KEYS, "left").withColumns(
        {
            "_rn": F.row_number().over(in_slice()),
            "_in_slice": F.lag(column, rows_back).over(in_slice()),
            "_first": F.first(column).over(in_slice().rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    # History index of the wanted row is rn - 1: 0 is rows_back rows before the slice.
    wanted = F.get("_history", F.col("_rn") - 1)
    if clamp:
        oldest = F.get(F.filter("_history", lambda x: x.isNotNull()), F.lit(0))
        inherited = (
            F.when(wanted.isNotNull(), wanted["v"])
            .when(oldest.isNotNull(), oldest["v"])
            .otherwise(F.col("_first"))
        )
    else:
        inherited = wanted["v"]
    value = F.when(F.col("_rn") > rows_back, F.col("_in_slice")).otherwise(inherited)
    return joined.withColumn(name, F.when(F.col(KEY).isNotNull(), value)).drop(
        SLICE, "_history", "_rn", "_in_slice", "_first"
    )


def first_seen(df: DataFrame) -> DataFrame:
    """(service, _from): position of the first row of each service."""
    return df.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.min(position()).alias("_from")
    )


def number_rows(
    df: DataFrame,
    services: DataFrame,
    name: str,
    width_us: int,
    start: int = 1,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Dense number in service-major order, services by their ``first_seen`` position.

    Counts per (service, slice) are added up in two steps, first over the slices of a
    service, then over services, so rows are only ordered inside a slice. ``counted`` has
    the same rows in a cheaper form, such as the written table ``df`` is made from.
    """
    rows = with_slice(df, width_us)
    source = rows if counted is None else with_slice(counted, width_us)
    per_slice = source.groupBy(*SLICE_KEYS).agg(F.count("*").alias("_n"))
    # One row per service is ordered in one task, never the rows themselves.
    by_first = Window.orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        per_slice.groupBy(KEY)
        .agg(F.sum("_n").alias("_n"))
        .join(services, KEY)
        .select(KEY, F.coalesce(F.sum("_n").over(by_first), F.lit(0)).alias("_service_base"))
    )
    slices = per_slice.select(
        *SLICE_KEYS, F.coalesce(F.sum("_n").over(earlier_slices()), F.lit(0)).alias("_slice_base")
    )
    return (
        rows.join(slices.join(bases, KEY), SLICE_KEYS)
        .withColumn(
            name,
            F.col("_service_base") + F.col("_slice_base")
            + F.row_number().over(in_slice()) + F.lit(start - 1),
        )
        .drop(SLICE, "_service_base", "_slice_base")
    )
