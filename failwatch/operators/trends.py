"""Failure trends over window rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from failwatch.operators import history
from failwatch.operators.trailing import (
    Moments, block_order, copy_to_blocks, home_rows, moved_after, only_copy, up_to_row,
    whole_block,
)
from failwatch.schemas import TREND_COLUMNS
from failwatch.settings import DEFAULTS, MINUTE_US, Settings


def failures_last_minute(df: DataFrame, label: str = "hybrid_label") -> DataFrame:
    """Add ``failures_1m``: FAILURE rows of the service in (t - 1 min, t]."""
    failed = F.coalesce((F.col(label) == "FAILURE").cast("bigint"), F.lit(0))
    rows = copy_to_blocks(df.withColumn("_failed", failed), MINUTE_US, ["_failed"])
    counted = rows.withColumn("_here", F.sum("_failed").over(up_to_row())).withColumn(
        "_moved", F.sum(only_copy(1, F.col("_failed"))).over(moved_after())
    )
    return (
        home_rows(counted)
        .withColumn("failures_1m", F.col("_here") + F.coalesce("_moved", F.lit(0)))
        .drop("_here", "_moved", "_failed")
    )


def _part(copy: int | None) -> dict[str, Column]:
    def pick(value: Column) -> Column:
        return value if copy is None else only_copy(copy, value)

    y = F.col("failures_1m").cast("double")
    return {
        "n": F.count(pick(F.lit(1))),
        "max": F.max(pick(y)),
        "var": F.var_pop(pick(y)),
        "sum": F.sum(pick(y)),
        "xy": F.sum(pick(y * F.col("_pos"))),
        "from": F.min(pick(F.col("_pos"))),
    }


def _trend(parts: list[str]) -> dict[str, Column]:
    """Maximum, sample variance and slope of consecutive parts.

    The slope regresses on the row position inside the frame, 0 to n-1, for which the
    sum of squares is n(n^2-1)/12; each part keeps its sum of position times value.
    """
    moments = None
    offset = F.lit(0.0)
    xy = F.lit(0.0)
    total = F.lit(0.0)
    for p in parts:
        part = Moments.of(f"{p}_n", F.try_divide(F.col(f"{p}_sum"), F.col(f"{p}_n")), f"{p}_var")
        moments = part if moments is None else moments + part
        part_sum = F.coalesce(f"{p}_sum", F.lit(0.0))
        start = F.coalesce(f"{p}_from", F.lit(0)).cast("double")
        xy = xy + F.coalesce(f"{p}_xy", F.lit(0.0)) + (offset - start) * part_sum
        total = total + part_sum
        offset = offset + F.coalesce(f"{p}_n", F.lit(0)).cast("double")
    n = offset
    slope = F.when(n > 1, (xy - (n - 1) / 2 * total) / (n * (n * n - 1) / 12))
    highest = F.greatest(*[f"{p}_max" for p in parts]) if len(parts) > 1 else F.col(f"{parts[0]}_max")
    return {
        "slope": F.coalesce(slope, F.lit(0.0)),
        "max_failures": highest,
        "variance": F.coalesce(moments.sample_variance(), F.lit(0.0)),
    }


def rolling_trends(df: DataFrame) -> DataFrame:
    """Add the six trend columns, given ``failures_1m``.

    Both widths share five-minute blocks and one exchange: ten minutes take the end of
    the block before the previous one, the whole previous block and the current start.
    """
    rows = copy_to_blocks(df, 5 * MINUTE_US, ["failures_1m"], blocks=2).withColumn(
        "_pos", F.row_number().over(block_order())
    )
    rows = rows.withColumns({f"_now_{k}": a.over(up_to_row()) for k, a in _part(None).items()})
    rows = rows.withColumns({f"_mid_{k}": a.over(whole_block()) for k, a in _part(1).items()})
    rows = rows.withColumns(
        {
            f"_{name}_{k}": a.over(moved_after())
            for name, copy in (("one", 1), ("two", 2))
            for k, a in _part(copy).items()
        }
    )
    rows = home_rows(rows)
    five = _trend(["_one", "_now"])
    ten = _trend(["_two", "_mid", "_now"])
    helpers = [c for c in rows.columns if c.startswith(("_now_", "_mid_", "_one_", "_two_"))]
    return rows.withColumns(
        {f"trend_{k}_5m": v for k, v in five.items()}
        | {f"trend_{k}_10m": v for k, v in ten.items()}
    ).drop(*helpers, "_pos")


def add_failure_trends(df: DataFrame) -> DataFrame:
    """Slope, maximum and variance of the one-minute failure count over 5 and 10 minutes.

    Zeros when there is no label column. Rows without a time are left out.
    """
    if "hybrid_label" not in df.columns:
        return df.withColumns({c: F.lit(0.0) for c in TREND_COLUMNS})
    timed = df.where(F.col("ts_us").isNotNull() & F.col("service_name").isNotNull())
    return rolling_trends(failures_last_minute(timed)).drop("failures_1m")


def add_ram_std_trend(
    df: DataFrame, rows_back: int = 3, settings: Settings = DEFAULTS
) -> DataFrame:
    """Change of ``ram_std`` per row over the last rows of the service, null to 0."""
    if "ram_std" not in df.columns:
        return df.withColumn("ram_std_trend", F.lit(0.0))
    aged = history.row_lag(df, "ram_std", rows_back, "_earlier", settings.slice_us)
    change = (F.col("ram_std") - F.col("_earlier")) / rows_back
    return aged.withColumn("ram_std_trend", F.coalesce(change, F.lit(0.0))).drop("_earlier")


def trend_report(df: DataFrame) -> DataFrame:
    """Mean and maximum of each trend column, one row per column."""
    stats = df.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in TREND_COLUMNS],
        *[F.max(c).alias(f"max_{c}") for c in TREND_COLUMNS],
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("trend"),
                F.col(f"avg_{c}").alias("mean"),
                F.col(f"max_{c}").alias("max"),
            )
            for c in TREND_COLUMNS
        ]
    )
    return stats.select(F.inline(pairs))


def with_label_fallback(df: DataFrame) -> DataFrame:
    """Take ``label``, or NORMAL, when there is no ``hybrid_label``."""
    if "hybrid_label" in df.columns:
        return df
    return df.withColumn(
        "hybrid_label", F.col("label") if "label" in df.columns else F.lit("NORMAL")
    )
