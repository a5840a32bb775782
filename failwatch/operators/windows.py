"""Features over the five minutes before each sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from failwatch.functions.timeaxis import from_micros
from failwatch.operators import history
from failwatch.operators.trailing import (
    Moments, block_order, copy_to_blocks, home_rows, moved_at_or_after, only_copy,
    strictly_before,
)
from failwatch.schemas import METRICS, WINDOW_COLUMNS
from failwatch.settings import DEFAULTS, MICROS, Settings

READ = [*METRICS, "ground_truth_label"]
PASSED_THROUGH = [
    "ts_us", "seq", "service_name", "stack", "log_template", "template_id",
    "ram_percent", "cpu_percent", "heap_mb_used", "gc_count",
    "hybrid_label", "ground_truth_label", "detection_layer", "failure_type",
]


def frame_features(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Features of the frame [t - width, t) of every row with enough earlier rows.

    Needs ts_us, seq, service_name, the four metrics and ground_truth_label; other
    columns pass through. Rows without service or time have no frame.
    """
    timed = df.where(F.col("ts_us").isNotNull() & F.col("service_name").isNotNull())
    rows = copy_to_blocks(timed, settings.window_us, READ).withColumns(
        {
            "_heap_step": F.col("heap_mb_used") - F.lag("heap_mb_used").over(block_order()),
            "_gc_step": F.coalesce(
                F.col("gc_count") > F.lag("gc_count").over(block_order()), F.lit(False)
            ).cast("int"),
        }
    )
    rows = rows.withColumns(
        {f"_b_{k}": a.over(strictly_before()) for k, a in _part(None).items()}
    )
    rows = rows.withColumns(
        {f"_a_{k}": a.over(moved_at_or_after()) for k, a in _part(1).items()}
    )
    return _merge(home_rows(rows), settings)


def _part(copy: int | None) -> dict[str, Column]:
    """Aggregates of one part of the frame, over one copy number when given."""

    def pick(value: Column) -> Column:
        return value if copy is None else only_copy(copy, value)

    edge = pick(
        F.struct("ts_us", "seq", "ram_percent", "heap_mb_used", "gc_count", "_heap_step", "_gc_step")
    )
    return {
        "n": F.count(pick(F.lit(1))),
        "first": F.min(edge),
        "last": F.max(edge),
        "ram_n": F.count(pick(F.col("ram_percent"))),
        "ram_mean": F.avg(pick(F.col("ram_percent"))),
        "ram_var": F.var_pop(pick(F.col("ram_percent"))),
        "ram_max": F.max(pick(F.col("ram_percent"))),
        "cpu_n": F.count(pick(F.col("cpu_percent"))),
        "cpu_sum": F.sum(pick(F.col("cpu_percent"))),
        "cpu_max": F.max(pick(F.col("cpu_percent"))),
        "heap_max": F.max(pick(F.col("heap_mb_used"))),
        "heap_steps": F.count(pick(F.col("_heap_step"))),
        "heap_moved": F.sum(pick(F.col("_heap_step"))),
        "gc_steps": F.sum(pick(F.col("_gc_step"))),
        "failed": F.max(pick((F.col("ground_truth_label") == "FAILURE").cast("int"))),
    }


def _merge(rows: DataFrame, settings: Settings) -> DataFrame:
    zero = F.lit(0)
    both = (F.col("_a_n") > 0) & (F.col("_b_n") > 0)
    # Steps inside the frame: those of both parts without the step into the first row
    # of the earlier part, plus the step from one part to the other.
    joint = F.when(both, F.col("_b_first.heap_mb_used") - F.col("_a_last.heap_mb_used"))
    gc_joint = F.when(
        both, (F.col("_b_first.gc_count") > F.col("_a_last.gc_count")).cast("int")
    )
    leading = F.col("_a_first._heap_step")
    heap_steps = (
        F.col("_a_heap_steps") + F.col("_b_heap_steps")
        - leading.isNotNull().cast("int") + joint.isNotNull().cast("int")
    )
    heap_moved = (
        F.coalesce("_a_heap_moved", F.lit(0.0)) + F.coalesce("_b_heap_moved", F.lit(0.0))
        - F.coalesce(leading, F.lit(0.0)) + F.coalesce(joint, F.lit(0.0))
    )
    gc_steps = (
        F.coalesce("_a_gc_steps", zero) + F.coalesce("_b_gc_steps", zero)
        - F.coalesce("_a_first._gc_step", zero) + F.coalesce(gc_joint, zero)
    )
    ram = Moments.of("_a_ram_n", F.col("_a_ram_mean"), "_a_ram_var") + Moments.of(
        "_b_ram_n", F.col("_b_ram_mean"), "_b_ram_var"
    )
    first = F.coalesce("_a_first", "_b_first")
    last = F.coalesce("_b_last", "_a_last")
    cpu_n = F.col("_a_cpu_n") + F.col("_b_cpu_n")
    cpu_sum = F.coalesce("_a_cpu_sum", F.lit(0.0)) + F.coalesce("_b_cpu_sum", F.lit(0.0))
    helpers = [c for c in rows.columns if c.startswith(("_a_", "_b_"))]
    return (
        rows.withColumn("window_rows", F.col("_a_n") + F.col("_b_n"))
        .where(F.col("window_rows") >= settings.min_window_rows)
        .withColumns(
            {
                "memory_growth": last["ram_percent"] - first["ram_percent"],
                "heap_rate": F.when(heap_steps > 0, heap_moved / heap_steps).otherwise(F.lit(0.0)),
                "gc_spike_count": gc_steps.cast("bigint"),
                "window_duration_seconds": (last["ts_us"] - first["ts_us"]) / F.lit(float(MICROS)),
                "ram_mean": ram.average(),
                "ram_max": F.greatest("_a_ram_max", "_b_ram_max"),
                "ram_std": F.sqrt(ram.sample_variance()),
                "cpu_mean": F.when(cpu_n > 0, cpu_sum / cpu_n),
                "cpu_max": F.greatest("_a_cpu_max", "_b_cpu_max"),
                "heap_max": F.greatest("_a_heap_max", "_b_heap_max"),
                "window_label": F.when(
                    F.greatest("_a_failed", "_b_failed") == 1, "FAILURE"
                ).otherwise("NORMAL"),
            }
        )
        .drop(*helpers, "_heap_step", "_gc_step")
    )


def sliding_windows(
    df: DataFrame, settings: Settings = DEFAULTS, keep: list[str] = ()
) -> DataFrame:
    """Window table without ids: pass-through columns, features and labels."""
    rows = df.select(*PASSED_THROUGH, *keep)
    return frame_features(rows, settings).withColumns(
        {"timestamp": from_micros(F.col("ts_us")), "label_source": F.lit("ground_truth")}
    )


def number_windows(
    windows: DataFrame,
    samples: DataFrame,
    settings: Settings = DEFAULTS,
    start: int = 1,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``window_id``: service after service in order of their first sample, by time
    within a service."""
    services = history.first_seen(samples.where(F.col("ts_us").isNotNull()))
    return history.number_rows(windows, services, "window_id", settings.slice_us, start, counted)


def window_table(df: DataFrame, settings: Settings = DEFAULTS, start: int = 1) -> DataFrame:
    """The published window columns plus row count, window label and the order keys."""
    numbered = number_windows(sliding_windows(df, settings), df, settings, start)
    return published(numbered)


def published(windows: DataFrame) -> DataFrame:
    return windows.select(*WINDOW_COLUMNS, "ts_us", "seq", "window_rows", "window_label")


def window_summary(windows: DataFrame) -> DataFrame:
    """Row count, mean duration, smallest and largest frame, label counts; one row."""
    return windows.agg(
        F.count("*").alias("windows"),
        F.coalesce(F.avg("window_duration_seconds"), F.lit(0.0)).alias("mean_duration_seconds"),
        F.coalesce(F.min("window_rows"), F.lit(0)).alias("min_rows"),
        F.coalesce(F.max("window_rows"), F.lit(0)).alias("max_rows"),
        F.count_if(F.col("ground_truth_label") == "FAILURE").alias("failure_windows"),
        F.count_if(F.col("ground_truth_label") == "NORMAL").alias("normal_windows"),
    )
