"""Evaluation of the labels against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from failwatch.functions import metrics
from failwatch.functions.metrics import confusion, f1, is_failure, precision, recall
from failwatch.functions.timeaxis import slot
from failwatch.operators import history
from failwatch.schemas import FEATURE_COLUMNS
from failwatch.settings import MICROS, MINUTE_US
from failwatch.storage import materialize

TRUTH = "ground_truth_label"
PREDICTED = "hybrid_label"

METHODS = ["Layer 1 only", "Layer 1 + 2", "Layer 3 only", "Full Hybrid"]


def scores() -> dict[str, Column]:
    return {"precision": precision(), "recall": recall(), "f1": f1()}


def _confusion() -> list[Column]:
    return confusion(is_failure(TRUTH), is_failure(PREDICTED))


def overall(windows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and the confusion counts; one row."""
    return windows.agg(*_confusion()).withColumns(scores())


def layer_counts() -> list[Column]:
    layer = F.col("detection_layer")
    return [
        F.count_if(layer.contains("keyword")).alias("keyword"),
        F.count_if(layer.contains("tfidf_semantic")).alias("tfidf_semantic"),
        F.count_if(layer.contains("metric_fusion")).alias("metric_fusion"),
    ]


def layer_contribution(windows: DataFrame) -> DataFrame:
    """Detections per layer among FAILURE rows and the semantic share in percent."""
    return (
        windows.where(is_failure(PREDICTED))
        .agg(F.count("*").alias("total_failures"), *layer_counts())
        .withColumn(
            "semantic_gain_percent",
            metrics.ratio(F.col("tfidf_semantic"), F.col("total_failures")) * 100.0,
        )
    )


def per_service(windows: DataFrame) -> DataFrame:
    """F1 per service with the stack of its first row."""
    # Counted per (service, stack) in a hash table; the few results are then merged.
    parts = (
        windows.where(F.col("service_name").isNotNull())
        .groupBy("service_name", "stack")
        .agg(F.min(history.position()).alias("_from"), *_confusion())
    )
    merged = parts.groupBy("service_name").agg(
        F.min_by("stack", "_from").alias("stack"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
    )
    return merged.select("service_name", "stack", f1().alias("f1"))


def feature_ranges(windows: DataFrame) -> DataFrame:
    """Minimum, mean and maximum of the nine features, one row per feature."""
    stats = windows.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.avg(c).alias("mean"),
                F.max(F.col(c).cast("double")).alias("max"),
            ).alias(c)
            for c in FEATURE_COLUMNS
        ]
    )
    return stats.select(F.inline(F.array(*FEATURE_COLUMNS)))


def ablation(windows: DataFrame) -> DataFrame:
    """Scores of the layers alone, together and of the final label, in one pass."""
    layer = F.coalesce(F.col("detection_layer"), F.lit(""))
    keyword = layer.contains("keyword")
    guesses = [
        keyword,
        keyword | layer.contains("tfidf"),
        layer.contains("metric_fusion"),
        is_failure(PREDICTED),
    ]
    counts = windows.agg(
        *[
            F.struct(F.lit(m).alias("method"), *confusion(is_failure(TRUTH), g)[:3]).alias(f"m{i}")
            for i, (m, g) in enumerate(zip(METHODS, guesses))
        ]
    )
    rows = counts.select(F.inline(F.array(*[f"m{i}" for i in range(len(METHODS))])))
    return rows.withColumns(scores())


def best_method(ablated: DataFrame) -> DataFrame:
    """Method of the highest F1 and its margin over the next; ties go to the first listed."""
    rank = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    # Four rows, one per method.
    ranked = ablated.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("f1")).alias("neg_f1"), rank.alias("rank"), "method"))).alias("r")
    )
    first, second = F.col("r")[0], F.get(F.col("r"), F.lit(1))
    return ranked.select(
        first["method"].alias("method"),
        (-first["neg_f1"]).alias("f1"),
        (F.coalesce(second["neg_f1"], F.lit(0.0)) - first["neg_f1"]).alias("improvement"),
    )


def leave_one_stack_out(windows: DataFrame) -> DataFrame:
    """Scores on each held-out stack."""
    return (
        windows.where(F.col("stack").isNotNull())
        .groupBy("stack")
        .agg(*_confusion(), F.count("*").alias("rows"))
        .withColumns(scores())
        .select("stack", "precision", "recall", "f1", "rows")
    )


def leave_one_stack_out_summary(windows: DataFrame, target: float = 0.70) -> DataFrame:
    """Average F1 over stacks and the stacks at or below the target."""
    weak = F.when(F.col("f1") <= target, F.col("stack"))
    return leave_one_stack_out(windows).agg(
        F.avg("f1").alias("average_f1"),
        F.concat_ws(", ", F.array_sort(F.collect_list(weak))).alias("underperforming"),
    )


def early_warnings(windows: DataFrame) -> DataFrame:
    """One row per ground-truth failure with the time since the first alert.

    The earliest alert before ``t`` is the first alert of the service if that is before
    ``t``, so one small aggregate per service replaces any look-back. It is written first:
    with its size known the failures are joined in place unless there are very many
    services.
    """
    timed = windows.where(F.col("ts_us").isNotNull() & F.col("service_name").isNotNull())
    parts = timed.groupBy("service_name", "stack").agg(
        F.min(F.when(is_failure(PREDICTED), F.col("ts_us"))).alias("_alert"),
        F.min(history.position()).alias("_from"),
    )
    known = F.when(F.col("stack").isNotNull(), F.col("_from"))
    services = materialize(parts.groupBy("service_name").agg(
        F.min("_alert").alias("_alert"),
        F.coalesce(F.min_by("stack", known), F.lit("Unknown")).alias("_stack"),
    ), "first-alerts")
    failures = timed.where(is_failure(TRUTH)).select("service_name", "ts_us", "seq")
    warned = F.col("_alert") < F.col("ts_us")
    lead = F.when(warned, F.col("ts_us") - F.col("_alert"))
    return failures.join(services, "service_name").select(
        "service_name",
        F.col("_stack").alias("stack"),
        "ts_us",
        "seq",
        lead.alias("warning_us"),
        (lead / F.lit(float(MINUTE_US))).alias("warning_min"),
        F.coalesce(warned, F.lit(False)).alias("predicted_early"),
    )


#: Ranges whose counts are ordered together; of these groups one row each is ordered.
RANGES_PER_GROUP = 4096
#: Relative rank error of the sketch is one in so many; the bracket is four times as wide on each side.
SKETCH_ACCURACY = 10_000


def exact_median(df: DataFrame, column: str, name: str, range_width: int = 10 * MICROS) -> DataFrame:
    """Exact median of a BIGINT column as one row, without gathering the values.

    A quantile sketch, merged over the tasks, brackets the middle ranks. Values outside the
    bracket are counted at its ends, so each task sends on only the values inside and two
    more. The counts are summed per range of values and per group of ranges. Only the groups that hold the middle are looked at range by range, and only the
    ranges that hold it value by value, so no window orders more than a group of ranges.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    share = 4 / SKETCH_ACCURACY
    ends = values.agg(F.percentile_approx("v", [0.5 - share, 0.5 + share], SKETCH_ACCURACY)).first()[0] or (0, 0)
    counts = materialize(
        values.groupBy(F.least(F.greatest("v", F.lit(ends[0])), F.lit(ends[1])).alias("v"))
        .agg(F.count("*").alias("n"))
        .withColumn("r", slot(F.col("v"), range_width)),
        "value-counts",
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("r").agg(F.sum("n").alias("rn"))
    total = ranges.agg(F.sum("rn").alias("total")).select(
        F.floor((F.col("total") + 1) / 2).alias("low"), F.floor((F.col("total") + 2) / 2).alias("high")
    )
    ranges = ranges.withColumn("g", slot(F.col("r"), RANGES_PER_GROUP))
    groups = ranges.groupBy("g").agg(F.sum("rn").alias("gn"))
    groups = groups.withColumn("g_start", F.coalesce(F.sum("gn").over(before.orderBy("g")), F.lit(0)))
    groups = groups.join(F.broadcast(total)).where(
        (F.col("g_start") < F.col("high")) & (F.col("g_start") + F.col("gn") >= F.col("low"))
    )
    start = F.col("g_start") + F.coalesce(F.sum("rn").over(before.partitionBy("g").orderBy("r")), F.lit(0))
    middle = ranges.join(groups, "g").withColumn("start", start).where(
        (F.col("start") < F.col("high")) & (F.col("start") + F.col("rn") >= F.col("low"))
    )
    placed = counts.join(F.broadcast(middle), "r").withColumn(
        "first", F.col("start") + F.coalesce(F.sum("n").over(before.partitionBy("r").orderBy("v")), F.lit(0))
    )
    inside = lambda rank: (F.col("first") < F.col(rank)) & (F.col(rank) <= F.col("first") + F.col("n"))
    return placed.agg(
        ((F.max(F.when(inside("low"), F.col("v"))) + F.max(F.when(inside("high"), F.col("v")))) / 2).alias(name)
    )


def early_warning_summary(warnings: DataFrame) -> DataFrame:
    """Totals, hit and miss shares, and the spread of the warning time; one row."""
    warnings = materialize(warnings, "warnings")
    stats = warnings.agg(
        F.count("*").alias("total_failures"),
        F.count_if("predicted_early").alias("successful"),
        F.min("warning_min").alias("min_warning"),
        F.max("warning_min").alias("max_warning"),
        F.avg("warning_min").alias("avg_warning"),
    )
    median = exact_median(warnings, "warning_us", "_median_us")
    # Both sides are one aggregate row.
    return stats.crossJoin(median).select(
        "total_failures",
        "successful",
        (F.col("total_failures") - F.col("successful")).alias("missed"),
        (metrics.ratio(F.col("successful"), F.col("total_failures")) * 100.0).alias("success_percent"),
        (
            metrics.ratio(F.col("total_failures") - F.col("successful"), F.col("total_failures")) * 100.0
        ).alias("missed_percent"),
        "min_warning",
        "max_warning",
        "avg_warning",
        (F.col("_median_us") / F.lit(float(MINUTE_US))).alias("median_warning"),
    )


def early_warning_by_service(warnings: DataFrame) -> DataFrame:
    """Mean warning per service and stack, longest first."""
    return (
        warnings.where(F.col("warning_min").isNotNull())
        .groupBy("service_name", "stack")
        .agg(F.avg("warning_min").alias("avg_warning_min"))
        .orderBy(F.desc("avg_warning_min"), "service_name")
    )
