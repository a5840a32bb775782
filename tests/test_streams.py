"""Streams with the engine's state: equal to the batch, over restarts, with late rows and a start state."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from failwatch.functions import frames
from failwatch.functions.timeaxis import from_micros
from failwatch.operators import history, trends, windows
from failwatch.schemas import METRICS, TREND_COLUMNS
from failwatch.settings import MINUTE_US
from failwatch.sinks import tables
from failwatch.sources.container import container_samples
from failwatch.storage import new_path
from failwatch.streaming import blocks, containers
from failwatch.streaming.operators import append_samples, read_samples_stream
from registry import adapter

SCHEMA = (
    "ts_us bigint, seq bigint, service_name string, stack string, log_template string, template_id bigint, log_message string, "
    "ram_percent double, cpu_percent double, heap_mb_used double, gc_count bigint, hybrid_label string, ground_truth_label string, "
    "detection_layer string, failure_type string"
)
START = 1_700_000_100 * 1_000_000


def samples(seed: int, n: int = 1500, minutes: int = 60) -> list[tuple]:
    """A hot service with two thirds of the rows, nulls, equal times and a service with few rows."""
    rng = random.Random(seed)
    rows, gc = [], 0
    for i in range(n):
        at = START + rng.randrange(minutes * 60) * 1_000_000
        gc += rng.choice([0, 0, 1, 4])
        maybe = lambda v: None if rng.random() < 0.1 else v
        label = rng.choice(["FAILURE", "NORMAL", "NORMAL", None])
        rows.append((at, i, rng.choice(["hot", "hot", "hot", "hot", "b", "c"]) if i % 300 else "rare", "st", f"t{i % 5}", i % 5,
                     rng.choice(["a gc pause", "ok", "  "]), maybe(rng.random() * 100), maybe(rng.random() * 90), maybe(rng.random() * 500),
                     maybe(gc), label, rng.choice(["FAILURE", "NORMAL"]), "normal", "none"))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(samples(4), SCHEMA)
    return df.withColumn("timestamp", from_micros(F.col("ts_us"))).persist()


def run(stream, path, checkpoint):
    append_samples(stream, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def in_two_runs(spark, rows, build):
    """Half of the time, a restart from the checkpoint, then the rest."""
    source, path, checkpoint = (new_path(spark, n) for n in ("in", "out", "checkpoint"))
    middle = START + 30 * MINUTE_US
    rows.where(F.col("ts_us") < middle).coalesce(1).write.mode("append").parquet(source)
    run(build(read_samples_stream(spark, source, rows.schema)), path, checkpoint)
    first = spark.read.parquet(path).count()
    rows.where(F.col("ts_us") >= middle).coalesce(1).write.mode("append").parquet(source)
    found = run(build(read_samples_stream(spark, source, rows.schema)), path, checkpoint)
    assert 0 < first < found.count()
    return found


def closed(df, newest):
    end = (F.floor(F.col("ts_us") / (5 * MINUTE_US)) + 1) * 5 * MINUTE_US
    return df.where(end <= newest - 2 * MINUTE_US)


def compare(mine, theirs, columns):
    got = {(r.service_name, r.seq): r for r in mine.collect()}
    expected = {(r.service_name, r.seq): r for r in theirs.collect()}
    assert got.keys() == expected.keys() and got
    for key, e in expected.items():
        for c in columns:
            a, b = got[key][c], e[c]
            assert a == b or (a is not None and b is not None and a == pytest.approx(b, abs=1e-7)) or (b is None and (a is None or a != a)), (key, c, a, b)


def test_frames_and_trends_over_a_restart(spark, rows):
    found = in_two_runs(spark, rows, blocks.frames_stream)
    newest = rows.agg(F.max("ts_us")).first()[0]
    batch = trends.add_failure_trends(windows.sliding_windows(rows))
    names = ["window_rows", "memory_growth", "heap_rate", "gc_spike_count", "window_duration_seconds", "ram_mean", "ram_max", "ram_std",
             "cpu_mean", "cpu_max", "heap_max", "window_label", "log_template", "ground_truth_label", "hybrid_label", *TREND_COLUMNS]
    compare(found, closed(batch, newest), names)


def test_frames_of_ten_minute_blocks(spark, rows):
    """The width of blocks changes when rows leave, not what is in them."""
    found = in_two_runs(spark, rows, lambda df: blocks.frames_stream(df, block_minutes=10))
    batch = trends.add_failure_trends(windows.sliding_windows(rows)).join(found.select("service_name", "seq"), ["service_name", "seq"], "left_semi")
    compare(found, batch, ["window_rows", "ram_std", *TREND_COLUMNS])


def test_fill_and_counters_over_a_restart(spark, rows):
    stored = in_two_runs(spark, rows, blocks.blocks_stream)
    summaries = spark.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0])
    carries = run(blocks.carries_stream(summaries), new_path(spark, "carries"), new_path(spark, "checkpoint"))
    columns = rows.select("service_name", "ts_us", "seq", "ram_percent", "cpu_percent", "heap_mb_used", F.col("gc_count").cast("double")).schema
    found = blocks.filled_rows(stored, carries, columns)
    newest = rows.agg(F.max("ts_us")).first()[0]
    filled = history.forward_fill(rows, METRICS, 5 * MINUTE_US)
    filled = history.running_total(filled, F.lower("log_message").contains("gc").cast("int"), "gc_seen", 5 * MINUTE_US)
    shown = history.row_lag(filled.where(F.trim("log_message") != ""), "gc_count", 9, "oldest", 5 * MINUTE_US, clamp=True)
    jumps = shown.select("service_name", "seq", (F.col("gc_count") - F.col("oldest")).alias("gc_jump"))
    compare(found, closed(filled, newest).join(jumps, ["service_name", "seq"], "left"), [*METRICS, "gc_seen", "gc_jump"])
    assert stored.groupBy("service_name").count().where("service_name = 'hot'").first()["count"] > 5


def test_start_state(spark, rows):
    """Numbers that a batch left go on in the stream."""
    stored = in_two_runs(spark, rows, blocks.blocks_stream)
    summaries = spark.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0])
    left = spark.createDataFrame(
        [("hot", 1.0, 2.0, None, 7.0, 100, [5.0, 6.0, 7.0])], f"service_name string, {blocks.CARRY}"
    )
    carries = run(blocks.carries_stream(summaries, initial=left), new_path(spark, "carries"), new_path(spark, "checkpoint"))
    first = {r.service_name: r for r in carries.groupBy("service_name").agg(F.min(F.struct("block", *blocks._CARRY_NAMES)).alias("r")).select("service_name", "r.*").collect()}
    assert tuple(first["hot"])[2:] == (1.0, 2.0, None, 7.0, 100, [5.0, 6.0, 7.0])
    assert tuple(first["b"])[2:] == (None, None, None, None, 0, [])


def test_late_rows_are_dropped(spark, rows):
    """A row behind the watermark changes nothing that has left."""
    source, path, checkpoint = (new_path(spark, n) for n in ("in", "out", "checkpoint"))
    rows.coalesce(1).write.mode("append").parquet(source)
    build = lambda: blocks.frames_stream(read_samples_stream(spark, source, rows.schema))
    before = run(build(), path, checkpoint).count()
    late = rows.limit(1).withColumns({"ts_us": F.lit(START + 1), "seq": F.lit(10**9).cast("bigint"), "timestamp": from_micros(F.lit(START + 1))})
    late.coalesce(1).write.mode("append").parquet(source)
    assert run(build(), path, checkpoint).where("seq = 1000000000").isEmpty()
    assert spark.read.parquet(path).count() == before


def test_container_samples_over_a_restart(spark, sf_dir):
    """Records and lines in, samples out, as the batch has them."""
    minute = F.col("ts_us") - F.pmod("ts_us", F.lit(MINUTE_US))
    stats = adapter.container_stats(spark, sf_dir).withColumn("ts_us", minute).where("name in ('svc-1', 'svc-2')")
    lines = adapter.log_lines(spark, sf_dir).where("name in ('svc-1', 'svc-2')").withColumn(
        "line", F.when(F.col("line_no") % 7 == 0, "gc pause").when(F.col("line_no") % 5 != 0, F.col("line")))
    inputs, path, checkpoint = (new_path(spark, "stats"), new_path(spark, "lines")), new_path(spark, "out"), new_path(spark, "checkpoint")
    low, newest = stats.agg(F.min("ts_us"), F.max("ts_us")).first()
    middle = (low + newest) // 2
    for part in (F.col("ts_us") < middle, F.col("ts_us") >= middle):
        for table, folder in zip((stats, lines), inputs):
            table.where(part).coalesce(1).write.mode("append").json(folder)
        streams = [spark.readStream.schema(t.schema).json(f) for t, f in zip((stats, lines), inputs)]
        stored = run(containers.container_blocks_stream(*streams), path, checkpoint)
    summaries = spark.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0])
    carries = run(blocks.carries_stream(summaries), new_path(spark, "carries"), new_path(spark, "checkpoint"))
    batch = container_samples(stats, lines.where("line is not null"))
    names = ["ts_us", "stack", "log_message", "log_level", *METRICS, "ground_truth_label"]
    compare(containers.container_rows(stored, carries), closed(batch, newest), names)
    assert batch.agg(F.max("gc_count")).first()[0] > 5


def test_failure_between_the_two_tables(spark, rows, monkeypatch):
    """The ML write of the second micro-batch fails once; after the restart both tables are whole."""
    source, audit, ml, checkpoint = (new_path(spark, n) for n in ("in", "audit", "ml", "checkpoint"))
    projects = spark.createDataFrame([("st", "project_1")], "stack string, project_id string")
    middle = START + 30 * MINUTE_US
    whole = tables.enrich.ml_rows

    def go():
        arrivals = read_samples_stream(spark, source, rows.schema)
        blocks.windows_to_tables(arrivals, audit, ml, projects, checkpoint).trigger(availableNow=True).start().awaitTermination()

    rows.where(F.col("ts_us") < middle).coalesce(1).write.mode("append").parquet(source)
    go()
    rows.where(F.col("ts_us") >= middle).coalesce(1).write.mode("append").parquet(source)

    def failing(*args):
        # The audit rows of this micro-batch are written, the ML rows are not.
        return whole(*args).withColumn("label", F.raise_error(F.lit("lost")).cast("string"))

    monkeypatch.setattr(tables.enrich, "ml_rows", failing)
    with pytest.raises(Exception):
        go()
    monkeypatch.setattr(tables.enrich, "ml_rows", whole)
    ahead = spark.read.parquet(audit).count()
    assert ahead > spark.read.parquet(ml).count()
    go()
    written, named = spark.read.parquet(audit), spark.read.parquet(ml)
    assert written.count() == named.count() == named.select("ts_us", "seq").distinct().count() >= ahead
    ids = sorted(r.window_id for r in written.select("window_id").collect())
    assert ids == list(range(1, len(ids) + 1)) == sorted(r.window_id for r in named.select("window_id").collect())


def test_sliding_max():
    rng = np.random.default_rng(1)
    values = np.where(rng.random(300) < 0.2, np.nan, rng.random(300))
    low = rng.integers(0, 300, 500)
    high = np.minimum(300, low + rng.integers(0, 70, 500))
    for got, a, b in zip(frames.sliding_max(values, low, high), low, high):
        part = values[a:b][~np.isnan(values[a:b])]
        assert (np.isnan(got) and not len(part)) or got == part.max()


def test_frames_of_nothing():
    none = np.zeros(0)
    assert all(len(v) == 0 for v in frames.frame_features(none.astype(np.int64), none, none, none, none, none.astype(bool)).values())
    assert all(len(v) == 0 for v in frames.failure_trends(none.astype(np.int64), none.astype(bool)).values())
