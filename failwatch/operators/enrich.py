"""Project ids, incident phases and the ML projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from failwatch.functions.timeaxis import micros, slot
from failwatch.schemas import AUDIT_COLUMNS, ML_COLUMNS, with_missing
from failwatch.settings import MICROS
from failwatch.storage import materialize

PRE_FAILURE_US = 5 * 60 * MICROS
EARLY_PHASE_US = 7 * 60 * MICROS


def project_ids(df: DataFrame, by: str, order: str = "window_id") -> DataFrame:
    """(by, project_id): ``project_n`` in order of first appearance of each value."""
    firsts = df.groupBy(by).agg(F.min(order).alias("_first"))
    # One row per stack or service: a small table, numbered in one task.
    rank = F.row_number().over(Window.orderBy("_first"))
    return firsts.select(by, F.concat(F.lit("project_"), rank).alias("project_id"))


def add_project_id(df: DataFrame, by: str = "stack", order: str = "window_id") -> DataFrame:
    # Written first, so that its known size lets the rows be joined without a shuffle.
    ids = materialize(project_ids(df, by, order).withColumnRenamed(by, "_by"), "projects")
    return df.drop("project_id").join(ids, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def _phases(before_us: Column, kind: Column) -> dict[str, Column]:
    """Label, phases and type from the time left until the failure."""
    after = before_us < 0
    close = (before_us >= 0) & (before_us <= PRE_FAILURE_US)
    early = (before_us > PRE_FAILURE_US) & (before_us <= EARLY_PHASE_US)
    return {
        "label": F.when(after, "FAILURE").when(close, "PRE_FAILURE").otherwise("NORMAL"),
        "incident_phase_1": F.when(after | close | early, 1).otherwise(0),
        "incident_phase_2": F.when(after | close, 1).otherwise(0),
        "failure_type": F.when(after | close, kind).otherwise(""),
    }


def label_incident_phases(
    df: DataFrame, failure_timestamp: Column, project_id: str, failure_type: str
) -> DataFrame:
    """Label rows by their distance to one failure time."""
    before = micros(failure_timestamp) - F.col("ts_us")
    return df.withColumns(
        {"project_id": F.lit(project_id), **_phases(before, F.lit(failure_type))}
    )


def label_incidents(df: DataFrame, incidents: DataFrame) -> DataFrame:
    """Label rows of many projects by an incident table.

    ``incidents`` has project_id, failure_ts and failure_type. A row looks at the next
    incident of its project; after the last one it counts as failed. Only incidents at
    most seven minutes ahead matter, so incidents are listed under the time slot they
    fall in and the one before. Rows and incidents of a (project, slot) are put in order of
    time once, latest first, and each row takes the smallest incident so far, so the work does
    not depend on how many incidents a slot holds.
    """
    times = incidents.select(
        "project_id", micros(F.col("failure_ts")).alias("at"), F.col("failure_type").alias("kind")
    )
    slots = F.array(slot(F.col("at"), EARLY_PHASE_US) - 1, slot(F.col("at"), EARLY_PHASE_US))
    # Columns stay columns, so those that nobody reads are not worked out.
    rows = df.drop("failure_type").withColumn("_mine", F.lit(True))
    # Rows without a time meet no incident and stay apart, spread over as many groups as partitions.
    untimed = F.lit(-(1 << 60)) - F.spark_partition_id()
    marks = (
        times.where(F.col("project_id").isNotNull())
        .groupBy("project_id", "at").agg(F.min(F.struct("at", "kind")).alias("_ahead"))
        .select("project_id", F.col("at").alias("ts_us"), F.explode(slots).alias("_slot"), "_ahead")
        .where(F.col("_slot").isNotNull())
    )
    both = rows.withColumn("_slot", F.coalesce(slot(F.col("ts_us"), EARLY_PHASE_US), untimed)).unionByName(
        marks, allowMissingColumns=True
    )
    later = (
        Window.partitionBy("project_id", "_slot")
        .orderBy(F.desc("ts_us"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    latest = times.groupBy("project_id").agg(F.max(F.struct("at", "kind")).alias("_latest"))
    joined = (
        both.withColumn("_next", F.min("_ahead").over(later))
        .where(F.col("_mine"))
        .join(latest, "project_id", "left")
    )
    past_all = F.when(F.col("_latest.at") < F.col("ts_us"), F.col("_latest"))
    nearest = joined.withColumn("_nearest", F.coalesce("_next", past_all))
    return nearest.withColumns(
        _phases(F.col("_nearest.at") - F.col("ts_us"), F.col("_nearest.kind"))
    ).drop("_latest", "_next", "_nearest", "_slot", "_ahead", "_mine")


def audit_table(windows: DataFrame) -> DataFrame:
    return with_missing(windows, AUDIT_COLUMNS).select(*AUDIT_COLUMNS)


def ml_rows(windows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The ML columns of windows that carry trends and a project id."""
    rows = with_missing(windows, [c for c in ML_COLUMNS if c != "label"]).withColumns(
        {
            "label": F.col("hybrid_label"),
            "failure_type": F.when(
                F.col("hybrid_label") == "FAILURE", F.col("failure_type")
            ).otherwise(""),
            "incident_phase_1": F.lit(0),
            "incident_phase_2": F.lit(0),
        }
    )
    return rows.select(*ML_COLUMNS, *keys)


def ml_table(windows: DataFrame, by: str = "stack") -> DataFrame:
    """The ML projection, project ids by first appearance of each ``by`` value."""
    return ml_rows(add_project_id(windows, by))
