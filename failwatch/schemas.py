"""Table schemas and column orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# The column names and orders of samples, windows and both output tables.
METRICS = ["ram_percent", "cpu_percent", "heap_mb_used", "gc_count"]

SAMPLES = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("stack", T.StringType()),
        T.StructField("log_level", T.StringType()),
        T.StructField("log_message", T.StringType()),
        T.StructField("ram_percent", T.DoubleType()),
        T.StructField("cpu_percent", T.DoubleType()),
        T.StructField("heap_mb_used", T.DoubleType()),
        T.StructField("gc_count", T.LongType()),
        T.StructField("ground_truth_label", T.StringType()),
        T.StructField("failure_type", T.StringType()),
    ]
)
SAMPLE_COLUMNS = SAMPLES.fieldNames()

# Order columns every operator works with: microseconds and source position.
ORDER = [T.StructField("ts_us", T.LongType()), T.StructField("seq", T.LongType())]

WINDOW_COLUMNS = [
    "window_id", "timestamp", "service_name", "stack",
    "log_template", "template_id",
    "ram_percent", "cpu_percent", "heap_mb_used", "gc_count",
    "memory_growth", "heap_rate", "gc_spike_count", "window_duration_seconds",
    "ram_mean", "ram_max", "ram_std", "cpu_mean", "cpu_max", "heap_max",
    "hybrid_label", "ground_truth_label", "label_source",
    "detection_layer", "failure_type",
]

AUDIT_COLUMNS = [c for c in WINDOW_COLUMNS if c != "window_duration_seconds"]

TREND_COLUMNS = [
    "trend_slope_5m", "trend_max_failures_5m", "trend_variance_5m",
    "trend_slope_10m", "trend_max_failures_10m", "trend_variance_10m",
]

ML_COLUMNS = [
    "timestamp", "project_id", "service_name", "window_id",
    "memory_growth", "heap_rate", "gc_spike_count",
    "ram_mean", "ram_max", "ram_std", "ram_std_trend",
    *TREND_COLUMNS,
    "heap_max", "gc_count", "ram_percent", "heap_mb_used",
    "label", "failure_type", "incident_phase_1", "incident_phase_2",
]

FEATURE_COLUMNS = [
    "memory_growth", "heap_rate", "gc_spike_count",
    "ram_mean", "ram_max", "ram_std", "cpu_mean", "cpu_max", "heap_max",
]
MODEL_COLUMNS = [*FEATURE_COLUMNS, "gc_count", "ram_percent", "heap_mb_used"]
NOVEL_FEATURES = ["memory_growth", "heap_rate", "gc_spike_count"]

LIVE_COLUMNS = [
    "service_name", "stack", "timestamp", "ram_percent", "cpu_percent",
    "heap_mb_used", "gc_count", "log_level", "log_message",
    "hybrid_label", "failure_type",
]

FEED_COLUMNS = [
    "window_id", "service_name", "memory_growth", "heap_rate", "gc_spike_count",
    "ram_mean", "ram_max", "ram_std", "cpu_mean", "cpu_max", "heap_max",
    "gc_count", "ram_percent", "heap_mb_used", "label", "failure_type", "timestamp",
]

_TYPES = {
    **{f.name: f.dataType for f in SAMPLES},
    **{c: T.DoubleType() for c in [*MODEL_COLUMNS, *TREND_COLUMNS, "ram_std_trend",
                                   "window_duration_seconds"]},
    "gc_count": T.LongType(),
    "gc_spike_count": T.LongType(),
    "window_id": T.LongType(),
    "template_id": T.LongType(),
    "incident_phase_1": T.IntegerType(),
    "incident_phase_2": T.IntegerType(),
}


def with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add every absent column of ``columns`` as a typed null."""
    absent = [c for c in columns if c not in df.columns]
    return df.withColumns(
        {c: F.lit(None).cast(_TYPES.get(c, T.StringType())) for c in absent}
    ) if absent else df
