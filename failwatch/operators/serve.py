"""The queries behind a dashboard or a polling consumer, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from failwatch.functions import metrics
from failwatch.functions.timeaxis import from_micros, iso
from failwatch.operators import evaluate
from failwatch.operators.history import position
from failwatch.schemas import FEED_COLUMNS, LIVE_COLUMNS, with_missing
from failwatch.settings import MINUTE_US


def status(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Row and window totals and the sorted services; one row."""
    named = F.when(F.col("service_name") != "", F.col("service_name"))
    # Services are made distinct before they are gathered: one entry each.
    services = samples.groupBy(named.alias("s")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.array_sort(F.collect_list("s")).alias("active_services"),
    )
    total = windows.agg(F.count("*").alias("total_windows"))
    return services.crossJoin(total).select("total_rows", "total_windows", "active_services")


def latest_per_service(samples: DataFrame) -> DataFrame:
    """Last timed row of each service.

    The position is one number, so its maximum is combined in a hash table before the
    shuffle; one row per service then picks the rows."""
    rows = with_missing(samples, LIVE_COLUMNS)
    timed = rows.where(F.col("ts_us").isNotNull() & F.col("service_name").isNotNull())
    placed = timed.select(
        "service_name", "ts_us", "seq", *[c for c in LIVE_COLUMNS if c != "service_name"], position().alias("_position")
    )
    last = placed.groupBy("service_name").agg(F.max("_position").alias("_position"))
    return placed.join(last, ["service_name", "_position"], "left_semi").drop("_position")


def alerts(latest: DataFrame) -> DataFrame:
    """Alert per service whose latest row is a failure."""
    return latest.where(metrics.is_failure("hybrid_label")).select(
        F.lit("failure_alert").alias("type"),
        "service_name", "failure_type", "hybrid_label", "ram_percent", "timestamp",
    )


def latest_windows(windows: DataFrame, limit: int = 50) -> DataFrame:
    """The newest windows by time."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    return windows.orderBy(F.desc("ts_us"), F.desc("seq")).limit(limit)


def latest_ml_rows(ml: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` rows of the ML table."""
    return ml.orderBy(F.desc("window_id")).limit(n)


def windows_since(ml: DataFrame, window_id: int) -> DataFrame:
    """Rows of the ML table after a cursor; the filter reaches the scan."""
    return ml.where(F.col("window_id") > window_id)


def top_templates(samples: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent templates and whether any of their rows failed."""
    return (
        samples.where(F.col("log_template").isNotNull())
        .groupBy(F.col("log_template").alias("template"))
        .agg(
            F.count("*").alias("count"),
            F.bool_or(metrics.is_failure("hybrid_label")).alias("failure_related"),
        )
        .orderBy(F.desc("count"), "template")
        .limit(limit)
    )


def window_totals(windows: DataFrame) -> DataFrame:
    """Totals and the failure share in percent, two decimals; one row."""
    failed = F.count_if(metrics.is_failure("hybrid_label"))
    return windows.agg(F.count("*").alias("total_windows"), failed.alias("failure_windows")).select(
        "total_windows",
        "failure_windows",
        (F.col("total_windows") - F.col("failure_windows")).alias("normal_windows"),
        F.round(
            metrics.ratio(F.col("failure_windows"), F.col("total_windows")) * 100.0, 2
        ).alias("failure_percent"),
    )


def layer_totals(windows: DataFrame) -> DataFrame:
    return windows.agg(*evaluate.layer_counts())


def f1_per_service(windows: DataFrame) -> DataFrame:
    """F1 per service, 0 for a service without true failures."""
    return evaluate.per_service(windows).select("service_name", "f1")


def failures_per_minute(windows: DataFrame, as_of_us: Column, minutes: int = 5) -> DataFrame:
    """FAILURE windows per minute over the last minutes before ``as_of_us``."""
    recent = windows.where(F.col("ts_us") >= as_of_us - F.lit(minutes * MINUTE_US))
    minute = F.date_trunc("minute", from_micros(F.col("ts_us")))
    return (
        recent.groupBy(minute.alias("minute"))
        .agg(F.count_if(metrics.is_failure("hybrid_label")).alias("failures"))
        .orderBy("minute")
        .select(F.date_format("minute", "HH:mm").alias("time"), "failures")
    )


def feed(windows: DataFrame, since_window_id: int = 0) -> DataFrame:
    """Windows after the cursor in id order, in the feed's column order."""
    rows = with_missing(windows, [c for c in FEED_COLUMNS if c != "label"])
    return (
        rows.where(F.col("window_id") > since_window_id)
        .withColumn("label", F.col("hybrid_label"))
        .orderBy("window_id")
        .select(*FEED_COLUMNS)
    )


def feed_cursor(windows: DataFrame, since_window_id: int = 0) -> DataFrame:
    """New cursor and number of new windows; one row."""
    return windows.where(F.col("window_id") > since_window_id).agg(
        F.coalesce(F.max("window_id"), F.lit(since_window_id).cast("bigint")).alias("last_window_id"),
        F.count("*").alias("new_windows_count"),
    )


def service_board(samples: DataFrame, ram_alarm: float = 70.0) -> DataFrame:
    """Latest metrics per service with the high-memory flag."""
    return latest_per_service(samples).select(
        "service_name", "ram_percent", "cpu_percent", "heap_mb_used", "gc_count", "log_level",
        F.coalesce(F.col("ram_percent") > ram_alarm, F.lit(False)).alias("ram_high"),
    )


def progress(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows, active services, mean of positive memory use and window label counts."""
    per_service = samples.groupBy("service_name").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("ram_percent") > 0, F.col("ram_percent"))).alias("ram"),
        F.count_if(F.col("ram_percent") > 0).alias("ram_n"),
    )
    left = per_service.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("service_name").alias("active_services"),
        metrics.ratio(F.sum("ram"), F.sum("ram_n")).alias("avg_ram"),
    )
    right = windows.agg(
        F.count_if(F.col("hybrid_label") == "FAILURE").alias("failure_windows"),
        F.count_if(F.col("hybrid_label") == "NORMAL").alias("normal_windows"),
    )
    # Both sides are one aggregate row.
    return left.crossJoin(right)


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept, times in ISO format, no NaN."""
    cells = []
    for field in df.schema:
        kind = field.dataType.typeName()
        column = F.col(field.name)
        if kind in ("timestamp", "timestamp_ntz"):
            column = iso(column)
        elif kind in ("double", "float"):
            column = metrics.nan_to_null(column)
        cells.append(column.alias(field.name))
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("record"))
