"""Batch, sinks and streams end to end on a small random fixture."""

from __future__ import annotations

import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import Window, functions as F, types as T

from failwatch.operators import classify, enrich
from failwatch.plans import jobs
from failwatch.plans.stages import Stages
from failwatch.schemas import AUDIT_COLUMNS, ML_COLUMNS, SAMPLES, TREND_COLUMNS
from failwatch.sinks import tables
from failwatch.sources import samples as sources
from failwatch.storage import materialize, shared_folder
from failwatch.streaming import operators as streams
from failwatch.streaming.live import LiveJob
from tests.fixtures import random_rows, rows_to_df

STREAM_SCHEMA = T.StructType([*SAMPLES, T.StructField("seq", T.LongType())])


@pytest.fixture(scope="module")
def samples(spark):
    rows = random_rows(240, seed=21)
    for r in rows:
        r["log_message"] = r["log_message"].replace("lost", "out of memory" if r["seq"] % 4 else "heap usage increasing")
    return materialize(rows_to_df(spark, rows), "test-samples")


@pytest.fixture(scope="module")
def stages(samples):
    return Stages(samples)


def test_batch_tables(spark, samples, tmp_path):
    result = jobs.run_batch(samples, str(tmp_path))
    audit = spark.read.parquet(str(tmp_path / "audit"))
    ml = sources.read_ml_table(spark, str(tmp_path / "ml_ready"))
    assert audit.columns == [*AUDIT_COLUMNS, "day"] and ml.columns == [*ML_COLUMNS, "day"]
    n = result.stages.window_rows.count()
    assert audit.count() == ml.count() == n
    assert ml.where("label = 'NORMAL' AND failure_type <> ''").count() == 0
    ids = [r[0] for r in ml.select("window_id").collect()]
    assert sorted(ids) == list(range(1, n + 1))
    counts = result.reports["overall"].first()
    assert counts["tp"] + counts["fp"] + counts["fn"] + counts["tn"] == n
    assert "ablation" in result.reports and len(result.reports) == 25
    seen = {r["service_name"]: r["rows"] for r in result.reports["rows_per_service"].collect()}
    assert sum(seen.values()) == samples.where("service_name is not null").count()
    assert sum(r["rows"] for r in result.reports["source_labels"].collect()) == samples.count()
    assert result.reports["quality"].count() == 1 and result.reports["trends"].count() == 6


def test_append_new_is_idempotent(spark, stages, tmp_path):
    windows = stages.trended
    projects = materialize(enrich.project_ids(windows, "stack"))
    audit, ml = str(tmp_path / "audit"), str(tmp_path / "ml")
    half = windows.where("seq % 2 = 0")
    assert tables.save_windows(half, audit, ml, projects) == half.count()
    assert tables.save_windows(half, audit, ml, projects) == 0
    assert tables.save_windows(windows, audit, ml, projects) == windows.count() - half.count()
    assert spark.read.parquet(ml).count() == windows.count()


def write_in_order_of_arrival(samples, path, files: int) -> None:
    """Files of rows that are up to 100 s out of order."""
    arrival = F.col("ts_us") + F.pmod(F.xxhash64("seq"), F.lit(100_000_000))
    parts = samples.withColumn("_part", F.ntile(files).over(Window.orderBy(arrival)))
    for i in range(1, files + 1):
        rows = parts.where(F.col("_part") == i).select(*STREAM_SCHEMA.fieldNames())
        rows.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.1)


def test_live_equals_batch_across_a_restart(spark, samples, stages, tmp_path):
    source = str(tmp_path / "in")
    vocabulary = classify.fit_terms(materialize(classify.distinct_templates(stages.templated))).vocabulary
    job = lambda: LiveJob(spark, str(tmp_path / "out"), str(tmp_path / "state"), delay_seconds=120, vocabulary=vocabulary)

    def run(live):
        stream = streams.read_samples_stream(spark, source, STREAM_SCHEMA, files_per_batch=1)
        live.start(stream, str(tmp_path / "checkpoint"), every=None).awaitTermination()

    half = samples.agg(F.percentile_approx("ts_us", 0.5)).first()[0]
    write_in_order_of_arrival(samples.where(F.col("ts_us") < half), source, 2)
    run(job())
    write_in_order_of_arrival(samples.where(F.col("ts_us") >= half), source, 1)
    last = job()
    run(last)
    last.finish()

    keys = ["service_name", "ts_us", "seq"]
    columns = ["log_template", "template_id", "hybrid_label", "detection_layer", "failure_type",
               "memory_growth", "heap_rate", "gc_spike_count", "ram_mean", "ram_std", "heap_max"]
    got = spark.read.parquet(str(tmp_path / "out/audit"))
    want = stages.trended
    as_rows = lambda df, c: sorted(
        str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*keys, *c).collect()
    )
    assert as_rows(got, columns) == as_rows(want, columns)
    ml = spark.read.parquet(str(tmp_path / "out/ml_ready"))
    assert as_rows(ml, [*TREND_COLUMNS, "ram_std_trend"]) == as_rows(want, [*TREND_COLUMNS, "ram_std_trend"])
    ids = sorted(r[0] for r in got.select("window_id").collect())
    assert ids == list(range(1, want.count() + 1))
    assert spark.read.parquet(str(tmp_path / "out/late")).count() == 0

    # The last micro-batch again: nothing is written twice.
    again = materialize(spark.read.parquet(str(tmp_path / "out/raw")).where("batch = 2").drop("batch"))
    job().process(again, 2)
    assert spark.read.parquet(str(tmp_path / "out/audit")).count() == len(ids)


def test_rows_behind_the_watermark_are_kept_aside(spark, tmp_path):
    from tests.fixtures import MIN, T0

    live = LiveJob(spark, str(tmp_path / "out"), str(tmp_path / "state"), delay_seconds=60)
    on_time = [{"ts_us": T0 + i * MIN, "log_message": f"step {i} done"} for i in range(8)]
    late = [{"seq": 100, "ts_us": T0, "log_message": "too late"}, {"seq": 101, "ts_us": T0 + 8 * MIN}]
    live.process(rows_to_df(spark, on_time), 0)
    live.process(rows_to_df(spark, late), 1)
    live.finish()
    assert [r["seq"] for r in spark.read.parquet(str(tmp_path / "out/late")).collect()] == [100]
    seqs = [r["seq"] for r in spark.read.parquet(str(tmp_path / "out/audit")).orderBy("seq").collect()]
    assert seqs == [3, 4, 5, 6, 7, 101]


def test_live_state_does_not_grow(spark, tmp_path, monkeypatch):
    from failwatch.streaming import live as module
    from tests.fixtures import MIN, T0

    monkeypatch.setattr(module, "VERSIONS", 1)
    state = tmp_path / "state"
    job = LiveJob(spark, str(tmp_path / "out"), str(state), delay_seconds=60)
    columns = [c for c in STREAM_SCHEMA.fieldNames() if c != "seq"]
    sizes = []
    for batch, (stack, seqs) in enumerate([("S0", range(5)), (None, range(5, 9))]):
        rows = [{"seq": i, "ts_us": T0 + i * MIN, "log_message": f"step {i} done", "stack": stack} for i in seqs]
        # Arrivals without a position are numbered on from the last one.
        job.process(rows_to_df(spark, rows).select(*columns).coalesce(1), batch)
        sizes.append({f.name: len(list(f.glob("batch=*"))) for f in state.iterdir()})
    assert sizes[1] == sizes[0] and max(sizes[1].values()) == 1
    job.process(rows_to_df(spark, []).select(*columns), 2)
    with pytest.raises(ValueError):
        job.process(rows_to_df(spark, rows).select(*columns), 0)
    job.finish()
    raw = spark.read.parquet(str(tmp_path / "out/raw"))
    assert sorted(r["seq"] for r in raw.collect()) == list(range(9))
    # Windows start behind three rows of the service; one id per stack for ever, also for none.
    ml = spark.read.parquet(str(tmp_path / "out/ml_ready")).orderBy("ts_us").collect()
    assert [r["project_id"] for r in ml] == ["project_1"] * 2 + ["project_2"] * 4
    folder = f"{shared_folder(spark)}/failwatch-{spark.sparkContext.applicationId}"
    assert not [name for name in os.listdir(folder) if name.startswith("scratch-")]


def test_a_state_folder_belongs_to_one_checkpoint(spark, tmp_path):
    source = str(tmp_path / "in")
    rows_to_df(spark, [{}]).select(*STREAM_SCHEMA.fieldNames()).write.parquet(source)
    live = LiveJob(spark, str(tmp_path / "out"), str(tmp_path / "state"))
    start = lambda name: live.start(streams.read_samples_stream(spark, source, STREAM_SCHEMA), str(tmp_path / name), every=None)
    start("one").awaitTermination()
    with pytest.raises(ValueError):
        start("two")


def test_live_finish_without_rows(spark, tmp_path):
    LiveJob(spark, str(tmp_path / "out"), str(tmp_path / "state")).finish()


def test_trees_do_not_grow_with_the_rows(spark):
    from pyspark.ml.functions import array_to_vector
    from failwatch.operators import importance

    def nodes(n):
        values = F.array(*[F.rand(k) for k in range(12)])
        rows = spark.range(n).select(array_to_vector(values).alias("features"), F.round(F.rand(99)).alias("label"), F.lit(False).alias("held_out"))
        forest = importance.train_forest(materialize(rows), trees=5, tree_rows=300)
        return max(t.numNodes for t in forest.trees)

    # Labels are noise, so trees are as large as their rows allow.
    assert 100 < nodes(3_000) < 2 * 400 and nodes(30_000) < 2 * 400


def test_kept_node_ids_give_the_same_forest(spark):
    """rows keep their node in every tree instead of walking down each tree in every pass."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from failwatch.operators import importance

    values = F.array(*[F.rand(k) for k in range(12)])
    rows = materialize(spark.range(400, numPartitions=2).select(
        array_to_vector(values).alias("features"), F.round(F.rand(99)).alias("label"), F.lit(False).alias("held_out")))
    forest = importance.train_forest(rows, trees=4)
    assert forest.getCacheNodeIds()
    walked = RandomForestClassifier(numTrees=4, maxDepth=importance.MAX_DEPTH, seed=importance.SEED, featureSubsetStrategy="sqrt").fit(rows)
    assert [t.toDebugString.split("\n")[1:] for t in forest.trees] == [t.toDebugString.split("\n")[1:] for t in walked.trees]


def test_importance_finds_the_planted_feature(spark):
    from failwatch.operators import importance
    from failwatch.schemas import MODEL_COLUMNS

    noise = {c: F.rand(i) for i, c in enumerate(MODEL_COLUMNS)}
    rows = spark.range(2000, numPartitions=4).select(
        F.lit("a").alias("service_name"), F.col("id").alias("ts_us"), F.col("id").alias("seq"), *[v.alias(c) for c, v in noise.items()]
    ).withColumn("ground_truth_label", F.when(F.col("heap_rate") > 0.7, "FAILURE").otherwise("NORMAL"))
    ranked = {r["feature"]: r for r in importance.feature_importance(materialize(rows), trees=20).collect()}
    assert ranked["heap_rate"]["rank"] == 1 and ranked["heap_rate"]["permutation_loss"] > 0.2
    assert all(abs(r["permutation_loss"]) < 0.05 for c, r in ranked.items() if c != "heap_rate")


def test_shuffled_values_are_the_features_own(spark):
    from failwatch.operators import importance

    rows = spark.range(50).select(F.lit(0.0).alias("label"), F.xxhash64("id").alias("draw"), F.array(F.col("id") + 0.5, -F.col("id") - 0.5).alias("values"))
    moved = importance._shuffled(rows).collect()
    for feature, sign in ((0, 1), (1, -1)):
        own = [r["values"] for r in moved if r["feature"] == feature]
        assert sorted(sign * v[feature] for v in own) == [i + 0.5 for i in range(50)]
        assert all(v[0] != -v[1] for v in own)


def test_shared_folder_comes_from_the_session(spark):
    def session(folder, master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder),
            sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
        )

    assert shared_folder(session("/shared", "yarn")) == "/shared"
    local = shared_folder(session(None, "local[2]"))
    assert local == shared_folder(session(None, "local[2]"))
    with pytest.raises(ValueError):
        shared_folder(session(None, "yarn"))
