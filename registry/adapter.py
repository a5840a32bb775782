"""Samples derived from the given ``events`` table, and raw container records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from failwatch.functions import text
from failwatch.functions.timeaxis import from_micros, micros
from failwatch.plans.stages import Stages

BASE_US = 1_704_067_200_000_000  # 2024-01-01
SQUEEZE = 300  # 30 days become 144 minutes
COPY_SEQ = 1_000_000_000
STACKS = ["Python/Flask", "Node.js/Express", "Java/SpringBoot", ".NET/Core", "Go/net_http"]
IMAGES = [
    "python:3.11", "node:20", "my/java-spring", "dotnet/aspnet", "golang:1.22", "redis:7",
]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def sample_columns() -> dict[str, F.Column]:
    event, value = F.col("event_id"), F.col("value")
    service = F.col("user_id") % 8
    number = event.cast("string")
    message = (
        F.when(event % 97 == 0, "  ")
        .when(
            F.col("event_type") == "error",
            F.when(event % 3 == 0, F.concat(F.lit("ERROR: out of memory (request #"), number, F.lit(")")))
            .when(event % 3 == 1, F.concat(F.lit("WARN memory heap usage increasing "), number, F.lit(" MB!")))
            .otherwise(F.concat(F.lit("ERROR CPU spike on core "), number)),
        )
        .otherwise(F.concat(F.lit("INFO "), F.col("event_type"), F.lit(" request "), number, F.lit(" served")))
    )
    return {
        "seq": event,
        "ts_us": F.lit(BASE_US)
        + F.call_function("div", micros(F.col("ts")) - BASE_US, F.lit(SQUEEZE).cast("bigint")),
        "service_name": F.concat(F.lit("svc-"), service),
        "stack": F.array(*[F.lit(s) for s in STACKS])[(service % 5).cast("int")],
        "log_message": message,
        "ram_percent": F.when(
            event % 17 != 0, F.when(value > 160, value).otherwise(value / 2)
        ),
        "cpu_percent": (event * 37 % 1300) / 10.0,
        "heap_mb_used": value * 5,
        "gc_count": F.call_function("div", event, F.lit(20).cast("bigint")),
        "ground_truth_label": F.when(
            (F.col("event_type") == "error") & (value > 20), "FAILURE"
        ).otherwise("NORMAL"),
        "failure_type": F.lit("none"),
    }


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples; every fiftieth row comes again later with another metric value."""
    once = events(spark, sf_dir).select(*[c.alias(n) for n, c in sample_columns().items()])
    again = once.where(F.col("seq") % 50 == 0).withColumns(
        {"seq": F.col("seq") + COPY_SEQ, "ram_percent": F.lit(1.0)}
    )
    return (
        once.unionByName(again)
        .withColumn("timestamp", from_micros(F.col("ts_us")))
        .withColumn("log_level", text.detect_log_level(F.col("log_message")))
    )


def with_mask_template(df: DataFrame) -> DataFrame:
    """Digit-token mask as template, which SQL can compute too."""
    return df.withColumn(
        "log_template", F.array_join(text.mask_numbers(text.tokens(F.col("log_message"))), " ")
    ).withColumn("template_id", F.length("log_template").cast("bigint"))


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    return Stages(samples(spark, sf_dir), templating=with_mask_template)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident table: very large errors of a service, the service being the project."""
    e = events(spark, sf_dir).where((F.col("event_type") == "error") & (F.col("value") > 100))
    columns = sample_columns()
    return e.select(
        columns["service_name"].alias("project_id"),
        from_micros(columns["ts_us"]).alias("failure_ts"),
        F.when(F.col("event_id") % 2 == 0, "memory_leak").otherwise("cpu_spike").alias("failure_type"),
    )


def container_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw statistics as JSON text, some records incomplete."""
    e = events(spark, sf_dir)
    columns = sample_columns()
    event = F.col("event_id")
    cores = (event % 5).cast("int")
    percpu = F.when(cores == 0, F.array().cast("array<bigint>")).when(
        cores > 1, F.array_repeat(event, cores)
    )
    stats = F.to_json(
        F.struct(
            F.struct(
                F.struct((event * 1000 + 700).alias("total_usage"), percpu.alias("percpu_usage")).alias("cpu_usage"),
                F.when(event % 101 == 0, event * 3000)
                .otherwise(event * 3000 + 7777)
                .alias("system_cpu_usage"),
            ).alias("cpu_stats"),
            F.struct(
                F.struct((event * 1000 + event % 7 * 10).alias("total_usage")).alias("cpu_usage"),
                (event * 3000).alias("system_cpu_usage"),
            ).alias("precpu_stats"),
            F.struct(
                F.when(event % 107 != 0, F.floor(F.col("value") * 1000000) + 1).alias("usage"),
                F.when(event % 103 == 0, 0).otherwise(536870912).cast("bigint").alias("limit"),
            ).alias("memory_stats"),
        )
    )
    return e.select(
        event.alias("seq"),
        columns["ts_us"].alias("ts_us"),
        columns["service_name"].alias("name"),
        F.array(*[F.lit(i) for i in IMAGES])[(F.col("user_id") % 6).cast("int")].alias("image_tag"),
        stats.alias("stats"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines grouped to ticks of one minute per service."""
    once = events(spark, sf_dir).select(*[c.alias(n) for n, c in sample_columns().items()])
    return once.select(
        F.col("service_name").alias("name"),
        (F.col("ts_us") - F.pmod("ts_us", F.lit(60_000_000))).alias("ts_us"),
        F.col("seq").alias("line_no"),
        F.col("log_message").alias("line"),
    )
