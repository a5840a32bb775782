"""Readers of the samples and ML tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from failwatch.functions import metrics
from failwatch.functions.timeaxis import micros
from failwatch.schemas import SAMPLES, with_missing

_TIME_AS_TEXT = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType) for f in SAMPLES]
)


#: A file's rows have numbers below two to this; it leaves room for two million files.
_FILE_BITS = 42


def with_order(df: DataFrame) -> DataFrame:
    """Add the order keys: microseconds and, unless given, the source position.

    Readers of files give the position in the files (``_positioned``); other tables get a
    number that grows along the scan.
    NaN metrics become null here, once, because Spark compares NaN as the largest value.
    """
    timed = df.withColumn("ts_us", micros(F.col("timestamp")))
    if "seq" not in df.columns:
        timed = timed.withColumn("seq", F.monotonically_increasing_id())
    return timed.withColumns(
        {f.name: metrics.nan_to_null(F.col(f.name)) for f in SAMPLES
         if isinstance(f.dataType, T.DoubleType)}
    )


def _positioned(df: DataFrame) -> DataFrame:
    """``seq`` by file name, place of the block in the file and row in the block.

    A scan packs files by size, so the order of the scan is not that of the files. A row takes
    at least a byte, so row numbers of a block end before the next block's start; only the last
    block of a file can come behind other rows in its partition.
    """
    # The two ways to name a file differ in the slashes behind the scheme.
    files = sorted({re.sub("^([a-z0-9]+):/+", r"\1:/", f) for f in df.inputFiles()})
    names = df.sparkSession.createDataFrame(list(enumerate(files)), "_file_no bigint, _file string")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.select("*", F.regexp_replace("_metadata.file_path", "^([a-z0-9]+):/+", "$1:/").alias("_file"), (F.col("_metadata.file_block_start") + row).alias("_place"))
    numbered = placed.join(names, "_file", "left")
    return numbered.withColumn("seq", F.shiftleft("_file_no", _FILE_BITS) + F.col("_place")).drop("_file", "_file_no", "_place")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Samples from CSV with a header; a time that cannot be read becomes null.

    Inside quotes a doubled quote is a quote, as the common writers of CSV have it.
    Spark raises an error when the path does not exist. No global sort: order lives in
    the order keys.
    """
    raw = spark.read.schema(_TIME_AS_TEXT).options(header=True, enforceSchema=False, escape='"').csv(path)
    return with_order(_positioned(raw).withColumn("timestamp", F.try_to_timestamp("timestamp")))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path)
    return with_order(with_missing(raw if "seq" in raw.columns else _positioned(raw), SAMPLES.fieldNames()))


def empty_samples(spark: SparkSession) -> DataFrame:
    return with_order(spark.createDataFrame([], SAMPLES))


def rows_per_service(df: DataFrame) -> DataFrame:
    return df.where(F.col("service_name").isNotNull()).groupBy("service_name").agg(
        F.count("*").alias("rows")
    )


def read_ml_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
