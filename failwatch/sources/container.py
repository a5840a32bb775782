"""Samples derived from raw container statistics and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from failwatch.functions import text
from failwatch.functions.timeaxis import from_micros
from failwatch.operators import history
from failwatch.schemas import SAMPLE_COLUMNS
from failwatch.settings import DEFAULTS, Settings

STATS_SCHEMA = """
    cpu_stats struct<cpu_usage: struct<total_usage: double, percpu_usage: array<double>>,
                     system_cpu_usage: double>,
    precpu_stats struct<cpu_usage: struct<total_usage: double>, system_cpu_usage: double>,
    memory_stats struct<usage: double, limit: double>
"""
BYTES_PER_MB = 1024 * 1024
LOG_TAIL = 3


def parse_stats(df: DataFrame) -> DataFrame:
    """Add cpu, ram and heap from the ``stats`` JSON, and ``stats_ok``.

    A record without one of the required fields is not ok; the caller counts and drops
    it.
    """
    s = df.withColumn("_s", F.from_json("stats", STATS_SCHEMA))
    total, before = F.col("_s.cpu_stats.cpu_usage.total_usage"), F.col("_s.precpu_stats.cpu_usage.total_usage")
    usage, limit = F.col("_s.memory_stats.usage"), F.col("_s.memory_stats.limit")
    system = F.coalesce("_s.cpu_stats.system_cpu_usage", F.lit(0.0)) - F.coalesce(
        "_s.precpu_stats.system_cpu_usage", F.lit(0.0)
    )
    cores = F.greatest(
        F.coalesce(F.size("_s.cpu_stats.cpu_usage.percpu_usage"), F.lit(1)), F.lit(1)
    )
    ok = total.isNotNull() & before.isNotNull() & usage.isNotNull() & limit.isNotNull()
    cpu = F.when(system > 0, (total - before) / F.when(system > 0, system) * cores * 100.0).otherwise(0.0)
    ram = F.when(limit > 0, usage / F.when(limit > 0, limit) * 100.0).otherwise(0.0)
    return s.withColumns(
        {
            "stats_ok": ok,
            "ram_percent": F.when(ok, F.round(ram, 4)),
            "cpu_percent": F.when(ok, F.round(cpu, 4)),
            "heap_mb_used": F.when(ok, F.round(usage / BYTES_PER_MB, 4)),
        }
    ).drop("_s")


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Accepted and rejected stats records."""
    return parsed.agg(
        F.count_if("stats_ok").alias("accepted"), F.count_if(~F.col("stats_ok")).alias("rejected")
    )


def last_lines(lines: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Last three log lines of each tick, joined by ``" | "``.

    Only three lines per tick survive the map side, so a chatty tick is not gathered.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    kept = lines.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= LOG_TAIL)
    parts = F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), "line")))
    return kept.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda p: p["line"]), " | ").alias("log_message")
    )


def gc_counter(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``gc_count``: rows so far whose message speaks of garbage collection."""
    return history.running_total(
        df, text.has_gc_word(F.col("log_message")), "gc_count", settings.slice_us
    )


def unlabelled() -> dict[str, Column]:
    return {"ground_truth_label": F.lit("UNKNOWN"), "failure_type": F.lit("none")}


def container_samples(
    stats: DataFrame, lines: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Samples from ``stats`` (seq, ts_us, name, image_tag, stats) and ``lines``
    (ts_us, name, line_no, line)."""
    messages = last_lines(lines, ["name", "ts_us"])
    rows = (
        parse_stats(stats)
        .where("stats_ok")
        .join(messages, ["name", "ts_us"], "left")
        .withColumns(
            {
                "timestamp": from_micros(F.col("ts_us")),
                "service_name": F.col("name"),
                "stack": text.detect_stack(F.col("image_tag")),
                "log_message": F.coalesce("log_message", F.lit("")),
                **unlabelled(),
            }
        )
        .withColumn("log_level", text.detect_log_level(F.col("log_message")))
    )
    return gc_counter(rows, settings).select(*SAMPLE_COLUMNS, "ts_us", "seq")
