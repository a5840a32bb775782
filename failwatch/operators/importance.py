"""Which features a forest uses to predict the true label."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from failwatch.functions.metrics import is_failure
from failwatch.operators import forest
from failwatch.schemas import MODEL_COLUMNS, NOVEL_FEATURES
from failwatch.storage import materialize, scratch

TREES = 200
SEED = 42
HELD_OUT = 0.2
#: The deepest trees the forest can grow.
MAX_DEPTH = 30
#: Training rows up to which Spark's trainer takes its split points from all of them and its trees are small enough
#: for the driver.
SPARK_ROWS = 10_000
#: Held-out rows among which a feature's values are exchanged.
SHUFFLED_ROWS = 10_000


def training_rows(windows: DataFrame) -> DataFrame:
    """Complete rows as (draw, features, label, held_out).

    The split hashes the row key, so it does not depend on partitioning.
    """
    kept = windows.where(F.col("ground_truth_label").isNotNull()).dropna(subset=MODEL_COLUMNS)
    draw = F.xxhash64("service_name", "ts_us", "seq", F.lit(SEED))
    labelled = kept.withColumns(
        {
            "draw": draw,
            "label": is_failure("ground_truth_label").cast("double"),
            "held_out": F.pmod(draw, F.lit(1000)) < int(HELD_OUT * 1000),
        }
    )
    assembler = VectorAssembler(inputCols=MODEL_COLUMNS, outputCol="features")
    return assembler.transform(labelled).select("draw", "features", "label", "held_out")


def row_counts(rows: DataFrame) -> DataFrame:
    """Training rows: how many, and how many of each class."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("label") == 1.0).alias("failures"),
        F.count_if(F.col("label") == 0.0).alias("normal"),
    )


def train_forest(
    rows: DataFrame, trees: int = TREES, max_depth: int = MAX_DEPTH, tree_rows: int | None = None
) -> RandomForestClassificationModel | forest.Forest:
    """Every tree draws as many rows as there are, with replacement; ``tree_rows`` is for callers that want fewer.

    Spark's trainer grows small forests; beyond, it would sample split points and keep all trees on the driver."""
    known = rows.where(~F.col("held_out"))
    n = known.count()
    if n > SPARK_ROWS and not tree_rows:
        return forest.grow(known, trees, max_depth, SEED)
    trainer = RandomForestClassifier(
        numTrees=trees, maxDepth=max_depth, seed=SEED, maxMemoryInMB=1024,
        subsamplingRate=min(1.0, tree_rows / max(1, n)) if tree_rows else 1.0, featureSubsetStrategy="sqrt",
        # Otherwise every pass sends all trees to all tasks and walks each row down each of them.
        cacheNodeIds=True,
    )
    return trainer.fit(known)


def _shuffled(rows: DataFrame) -> DataFrame:
    """Every row once per feature, with that feature's value taken from another row.

    Rows are dealt to groups of about SHUFFLED_ROWS by hash and pass their value on along
    an order by another hash, so no group holds more and one exchange serves all features.
    """
    groups = F.ceil(F.lit(rows.count()) / SHUFFLED_ROWS)
    cells = rows.select(
        "label", "draw", F.col("values"), F.posexplode("values").alias("feature", "value")
    ).withColumns({"_group": F.pmod(F.xxhash64("draw"), groups), "_order": F.xxhash64("draw", "feature")})
    order = Window.partitionBy("feature", "_group").orderBy("_order", "draw")
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taken = F.coalesce(F.lead("value").over(order), F.first("value").over(everyone))
    moved = cells.withColumn("_taken", taken)
    values = F.transform("values", lambda v, i: F.when(i == F.col("feature"), F.col("_taken")).otherwise(v))
    return moved.select("label", "feature", values.alias("values"))


def permutation_importance(model: RandomForestClassificationModel | forest.Forest, rows: DataFrame) -> DataFrame:
    """(feature, loss): accuracy lost on ``rows`` when a feature's values change places.

    All features and the untouched rows are scored in one pass; no rows gives no result."""
    plain = rows.select("label", "draw", vector_to_array("features").alias("values"))
    whole = plain.select("label", F.lit(-1).alias("feature"), "values")
    versions = whole.union(_shuffled(plain)).select("label", "feature", array_to_vector("values").alias("features"))
    scored = model.transform(versions)
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    accuracy = scored.groupBy("feature").agg(right.alias("accuracy"))
    base = F.max(F.when(F.col("feature") == -1, F.col("accuracy"))).over(Window.partitionBy())
    return accuracy.select("feature", (base - F.col("accuracy")).alias("loss")).where("feature >= 0")


def _ranked(spark: SparkSession, scores: list[float], losses: dict[int, float]) -> DataFrame:
    """Features by score, with their share, category and permutation loss; twelve rows."""
    table = spark.createDataFrame(
        [(i, c, float(s), losses.get(i)) for i, (c, s) in enumerate(zip(MODEL_COLUMNS, scores))],
        "place int, feature string, importance double, permutation_loss double",
    )
    total = F.sum("importance").over(Window.partitionBy())
    order = Window.orderBy(F.desc("importance"), "place")
    category = F.when(F.col("feature").isin(NOVEL_FEATURES), "Novel").otherwise("Standard")
    return table.select(
        F.row_number().over(order).alias("rank"),
        "feature",
        "importance",
        F.when(total > 0, F.col("importance") / total * 100.0).otherwise(0.0).alias("percent"),
        category.alias("category"),
        "permutation_loss",
    )


def feature_importance(windows: DataFrame, trees: int = TREES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Impurity importance of the twelve features, ranked, and what each is worth on held-out rows."""
    rows = materialize(training_rows(windows), "training")
    if rows.where(~F.col("held_out")).isEmpty():
        return _ranked(windows.sparkSession, [0.0] * len(MODEL_COLUMNS), {}).limit(0)
    with scratch(windows.sparkSession):
        model = train_forest(rows, trees, max_depth)
        # Twelve rows.
        lost = permutation_importance(model, rows.where("held_out")).collect()
    losses = {r["feature"]: r["loss"] for r in lost}
    return _ranked(windows.sparkSession, list(model.featureImportances.toArray()), losses)


def novel_share(ranked: DataFrame) -> DataFrame:
    """Share of the novel and of the standard features in percent; one row."""
    novel = F.col("category") == "Novel"
    return ranked.agg(
        F.sum(F.when(novel, F.col("percent")).otherwise(0.0)).alias("novel_percent"),
        F.sum(F.when(novel, 0.0).otherwise(F.col("percent"))).alias("standard_percent"),
    )
