"""Cleaning of raw samples. The order of the steps matters: see ``preprocess``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from failwatch.functions import metrics, text
from failwatch.operators import history
from failwatch.schemas import METRICS
from failwatch.settings import DEFAULTS, METRIC_BOUNDS, Settings
from failwatch.storage import materialize

DUPLICATE_KEYS = ["ts_us", "service_name", "log_message"]
QUALITY_COLUMNS = ["seq", *DUPLICATE_KEYS, *METRICS]


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first row in source order of each (time, service, message).

    ``row_number() = 1`` is limited on the map side before the shuffle, so a large
    group of copies does not travel to one task.
    """
    first = Window.partitionBy(*DUPLICATE_KEYS).orderBy("seq")
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def fill_metrics(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Forward-fill the four metrics per service."""
    return history.forward_fill(df, METRICS, settings.slice_us)


def drop_blank_messages(df: DataFrame) -> DataFrame:
    return df.where(~text.is_blank(F.col("log_message")))


def clip_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: metrics.clip(F.col(c), low, high) for c, (low, high) in METRIC_BOUNDS.items()}
    )


def clean_messages(df: DataFrame) -> DataFrame:
    return df.withColumn("log_message", text.clean_message(F.col("log_message")))


def drop_untimed(df: DataFrame) -> DataFrame:
    """Drop rows whose time could not be read."""
    return df.where(F.col("ts_us").isNotNull())


def preprocess(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Dedupe, fill, drop blank messages, clip, clean.

    Filling comes before the blank messages go, so their metrics carry forward.
    """
    return after_dedupe(drop_duplicates(df), settings)


def after_dedupe(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The steps after dropping duplicates. Filling reads ``df`` twice."""
    return (
        df.transform(fill_metrics, settings)
        .transform(drop_blank_messages)
        .transform(clip_metrics)
        .transform(clean_messages)
    )


def quality_report(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row of counters: rows before, removed, nulls filled, values clipped.

    Remaining nulls are not counted as clipped.
    """
    unique = materialize(drop_duplicates(df.select(*QUALITY_COLUMNS)), "deduped")
    filled = fill_metrics(
        unique.withColumns({f"_raw_{c}": F.col(c) for c in METRICS}), settings
    )
    kept = ~text.is_blank(F.col("log_message"))
    nulls_filled = sum(
        (F.count_if(F.col(f"_raw_{c}").isNull() & F.col(c).isNotNull()) for c in METRICS),
        F.lit(0),
    )
    outside = sum(
        (
            F.count_if(kept & ((F.col(c) < low) | (F.col(c) > high)))
            for c, (low, high) in METRIC_BOUNDS.items()
        ),
        F.lit(0),
    )
    after = filled.agg(
        F.count_if(kept).alias("rows_after"),
        nulls_filled.alias("nulls_filled"),
        outside.alias("outliers_clipped"),
    )
    before = df.agg(F.count("*").alias("rows_before"))
    # Both sides are one aggregate row.
    return before.crossJoin(after).select(
        "rows_before",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        "nulls_filled",
        "outliers_clipped",
    )
