"""Streaming forms of single operators, with built-in state only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from failwatch.functions.metrics import is_failure
from failwatch.operators import preprocess, serve
from failwatch.schemas import LIVE_COLUMNS, SAMPLES, with_missing


def read_samples_stream(
    spark: SparkSession, path: str, schema: StructType = SAMPLES, file_format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Samples arriving as files; other sources give the same columns."""
    reader = spark.readStream.schema(schema).format(file_format)
    if file_format == "csv":
        reader = reader.options(header=True, escape='"')
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def drop_duplicates_stream(df: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """First arrival of each (time, service, message) within the watermark."""
    keys = ["timestamp" if k == "ts_us" else k for k in preprocess.DUPLICATE_KEYS]
    return df.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(keys)


def failures_per_minute_stream(df: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """FAILURE rows per service and minute, final once the watermark has passed."""
    return (
        df.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 minute"), "service_name")
        .agg(F.count_if(is_failure("hybrid_label")).alias("failures"))
        .select(F.col("window.start").alias("minute"), "service_name", "failures")
    )


def latest_per_service_stream(df: DataFrame) -> DataFrame:
    """Latest row of each service; one row of state per service, combined map-side."""
    rows = with_missing(df, LIVE_COLUMNS).where(F.col("ts_us").isNotNull() & F.col("service_name").isNotNull())
    payload = F.struct("ts_us", "seq", *[c for c in LIVE_COLUMNS if c != "service_name"])
    latest = rows.groupBy("service_name").agg(F.max_by(payload, F.struct("ts_us", "seq")).alias("_row"))
    return latest.select("service_name", "_row.*")


def alerts_stream(df: DataFrame) -> DataFrame:
    """Alert whenever the latest row of a service is a failure (update mode)."""
    return serve.alerts(latest_per_service_stream(df))


def append_samples(df: DataFrame, path: str, checkpoint: str, file_format: str = "parquet") -> DataStreamWriter:
    """Exactly-once append of arriving samples to files."""
    return (
        df.writeStream.format(file_format)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
