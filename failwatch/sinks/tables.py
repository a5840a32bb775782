"""Writers of the raw, audit and ML tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from failwatch.operators import enrich
from failwatch.operators.history import first_seen, number_rows
from failwatch.schemas import SAMPLE_COLUMNS, with_missing
from failwatch.settings import DEFAULTS
from failwatch.storage import exists, materialize, names_in, remove

DAY = "day"
BATCH = "batch"
# Messages keep their blanks, and a quote inside quotes is doubled.
CSV = {
    "header": True, "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
# What identifies a written row; kept in the stored tables next to their columns.
ROW_KEYS = ["service_name", "ts_us", "seq"]


def _by_day(df: DataFrame) -> DataFrame:
    """Rows of a day together in files of even size; large days are split."""
    return df.withColumn(DAY, F.to_date("timestamp")).hint("rebalance", DAY)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", file_format: str = "parquet") -> None:
    writer = _by_day(df).write.mode(mode).partitionBy(DAY).format(file_format)
    if file_format == "csv":
        writer = writer.options(**CSV)
    writer.save(path)


def write_audit(windows: DataFrame, path: str, file_format: str = "parquet") -> None:
    """The 24 audit columns, partitioned by day."""
    write_table(enrich.audit_table(windows), path, file_format=file_format)


def write_ml(windows: DataFrame, path: str, by: str = "stack", file_format: str = "parquet") -> None:
    """The 25 ML columns of windows that carry their trends, partitioned by day."""
    write_table(enrich.ml_table(windows, by), path, file_format=file_format)


def write_samples(samples: DataFrame, path: str, file_format: str = "csv") -> None:
    """All samples in the fixed column order, replacing what was there."""
    rows = with_missing(samples, SAMPLE_COLUMNS).select(*SAMPLE_COLUMNS)
    writer = rows.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.options(**CSV)
    writer.save(path)


def append_new(df: DataFrame, path: str, keys: list[str] = ROW_KEYS) -> int:
    """Append the rows whose key is not in the table yet; gives their number.

    Only days the batch touches are looked at, so the cost follows the batch, and running
    the same batch again adds nothing.
    """
    spark = df.sparkSession
    rows = df.withColumn(DAY, F.to_date("timestamp"))
    if exists(spark, path):
        written = spark.read.parquet(path)
        # A batch spans few days; the list prunes partitions of the stored table.
        days = [r[DAY] for r in rows.select(DAY).distinct().collect()]
        rows = rows.join(written.where(F.col(DAY).isin(days)).select(DAY, *keys), [DAY, *keys], "left_anti")
    rows = materialize(rows, "append")
    added = rows.count()
    if added:
        rows.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)
    return added


def save_windows(windows: DataFrame, audit_path: str, ml_path: str, projects: DataFrame) -> int:
    """Append new windows, which carry trends and ids, to both tables.

    ``projects`` (stack, project_id) keeps project ids stable between calls.
    """
    keys = ["ts_us", "seq"]
    audit = with_missing(windows, enrich.AUDIT_COLUMNS).select(*enrich.AUDIT_COLUMNS, *keys)
    ids = projects.select(F.col("stack").alias("_stack"), "project_id")
    named = windows.join(ids, windows["stack"].eqNullSafe(ids["_stack"]), "left").drop("_stack")
    ml = enrich.ml_rows(named, keys)
    added = append_new(audit, audit_path)
    append_new(ml, ml_path)
    return added


def save_batch(windows: DataFrame, audit_path: str, ml_path: str, projects: DataFrame, batch: int) -> None:
    """Write the windows of a micro-batch to both tables, in a partition of its own.

    A repeated micro-batch replaces its partition, so a failure between the two writes leaves
    nothing twice and nothing out, and no written row is looked at. Window ids go on from the last
    earlier micro-batch that has windows."""
    spark = windows.sparkSession
    earlier = [int(n.removeprefix(f"{BATCH}=")) for n in names_in(spark, audit_path) if n.startswith(f"{BATCH}=")]
    last = max((b for b in earlier if b < batch), default=None)
    start = 0 if last is None else spark.read.parquet(f"{audit_path}/{BATCH}={last}").agg(F.max("window_id")).first()[0]
    rows = materialize(windows, "batch-windows")
    services = first_seen(rows)
    numbered = number_rows(rows, services, "window_id", DEFAULTS.slice_us, start + 1)
    ids = projects.select(F.col("stack").alias("_stack"), "project_id")
    named = numbered.join(ids, numbered["stack"].eqNullSafe(ids["_stack"]), "left").drop("_stack")
    keys = ["ts_us", "seq"]
    audit = with_missing(named, enrich.AUDIT_COLUMNS).select(*enrich.AUDIT_COLUMNS, *keys)
    for table, path in ((audit, audit_path), (enrich.ml_rows(named, keys), ml_path)):
        writer = _by_day(table.withColumn(BATCH, F.lit(batch))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BATCH, DAY).parquet(path)
    remove(rows)
