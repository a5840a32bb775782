"""Parameter sweeps: corpus size and window width."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from failwatch.functions import metrics
from failwatch.functions.metrics import confusion, f1, is_failure, precision, recall
from failwatch.operators import classify, history
from failwatch.settings import (
    CORPUS_SIZES, DEFAULTS, MINUTE_US, Settings, WINDOW_SWEEP_MINUTES,
)
from failwatch.storage import materialize


def corpus_size_sweep(
    df: DataFrame, sizes: list[int] = CORPUS_SIZES, settings: Settings = DEFAULTS
) -> DataFrame:
    """Scores of the semantic layer alone for each corpus size.

    Rows are reduced to label counts per template first; the sizes meet templates, not
    rows.
    """
    truth = is_failure("ground_truth_label")
    per_template = materialize(
        df.where(F.col("log_template").isNotNull())
        .groupBy("log_template")
        .agg(F.count_if(truth).alias("_pos"), F.count_if(~truth).alias("_neg")),
        "template-counts",
    )
    found = per_template.select("log_template")
    similar = classify.template_similarity(found, classify.fit_terms(found, sizes, settings))
    hit = classify.semantic_hit(F.col("similarity"), settings.semantic_threshold)
    counts = (
        similar.join(per_template, "log_template")
        .groupBy("size")
        .agg(
            F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, F.col("_neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(~hit, F.col("_pos")).otherwise(0)).alias("fn"),
        )
    )
    return counts.select(
        "size", precision().alias("precision"), recall().alias("recall"), f1().alias("f1")
    )


def best_of(swept: DataFrame, by: str) -> DataFrame:
    """Row with the highest F1, the smallest ``by`` on a tie."""
    return swept.orderBy(F.desc("f1"), by).limit(1)


def window_width_sweep(
    df: DataFrame,
    minutes: list[int] = WINDOW_SWEEP_MINUTES,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Windows, FAILURE share and F1 for each frame width, in one pass.

    A row has a window when its frame holds enough rows. That is decided by the last few
    distinct times before it, so rows are reduced to one per (service, time) and each
    looks back a fixed number of them, whatever the widths.
    """
    need = settings.min_window_rows
    timed = df.where(F.col("ts_us").isNotNull() & F.col("service_name").isNotNull())
    ticks = timed.groupBy("service_name", "ts_us").agg(
        F.count("*").alias("_rows"),
        *confusion(is_failure("ground_truth_label"), is_failure("hybrid_label")),
    )
    # Written once: looking back reads the ticks twice.
    looked = history.previous_rows(
        materialize(ticks.withColumn("seq", F.lit(0).cast("bigint")), "ticks"),
        F.struct("ts_us", "_rows"), need, "_before", settings.slice_us,
    )
    widths = F.explode(F.array(*[F.lit(m) for m in minutes])).alias("window_minutes")
    counted = looked.select("*", widths).where(
        F.aggregate(
            "_before",
            F.lit(0).cast("bigint"),
            lambda acc, p: acc
            + F.when(
                p["ts_us"] >= F.col("ts_us") - F.col("window_minutes") * F.lit(MINUTE_US), p["_rows"]
            ).otherwise(0),
        )
        >= need
    )
    totals = counted.groupBy("window_minutes").agg(
        F.sum("_rows").alias("total_windows"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    )
    # One row per width, so a width without any window still shows up.
    every = df.sparkSession.createDataFrame([(m,) for m in minutes], "window_minutes int")
    full = every.join(totals, "window_minutes", "left").na.fill(0)
    failures = F.col("tp") + F.col("fn")
    return full.select(
        "window_minutes",
        "total_windows",
        failures.alias("failure_windows"),
        (metrics.ratio(failures, F.col("total_windows")) * 100.0).alias("failure_percent"),
        f1().alias("f1"),
    )
