"""Look-back operators against plain scans, with one busy service and equal times."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from failwatch.operators import classify, history, preprocess, trends, windows
from failwatch.settings import Settings
from tests.fixtures import (
    MIN, T0, by_service, close, frame_reference, random_rows, rows_to_df, trend_reference,
)


def check(df, expected: dict[int, dict]):
    got = {r["seq"]: r.asDict() for r in df.collect()}
    assert set(got) == set(expected)
    for seq, want in expected.items():
        for name, value in want.items():
            assert close(got[seq][name], value), (seq, name, got[seq][name], value)


@pytest.mark.parametrize("minutes", [1, 5, 12])
def test_frames_equal_scan(spark, minutes):
    rows = random_rows(400)
    df = windows.frame_features(rows_to_df(spark, rows), Settings(window_minutes=minutes))
    check(df, frame_reference(rows, minutes * MIN))


def test_frame_bounds(spark):
    """Five minutes before is in, a microsecond earlier is out, the row's own time is out."""
    t = T0 + 10 * MIN
    times = [t - 5 * MIN - 1, t - 5 * MIN, t - 2, t - 1, t, t]
    df = windows.frame_features(rows_to_df(spark, [{"ts_us": x} for x in times]))
    rows = {r["seq"]: r["window_rows"] for r in df.collect()}
    assert rows[4] == rows[5] == 3


@pytest.mark.parametrize("n,expected", [(3, 0), (4, 1)])
def test_short_service(spark, n, expected):
    rows = [{"ts_us": T0 + i * 1_000_000} for i in range(n)]
    assert windows.frame_features(rows_to_df(spark, rows)).count() == expected


def test_rows_without_time_or_service_have_no_window(spark):
    rows = [{"ts_us": T0 + i * 1_000_000} for i in range(5)]
    rows += [{"ts_us": None}] + [{"ts_us": T0 + i, "service_name": None} for i in range(6)]
    assert windows.frame_features(rows_to_df(spark, rows)).count() == 2


def test_trends_equal_scan(spark):
    rows = random_rows(400, seed=11)
    df = rows_to_df(spark, rows).join(
        spark.createDataFrame([(r["seq"], r["hybrid_label"]) for r in rows], "seq bigint, hybrid_label string"),
        "seq",
    )
    check(trends.rolling_trends(trends.failures_last_minute(df)), trend_reference(rows))


def test_trend_minute_bound(spark):
    t = T0 + 30 * MIN
    rows = [{"ts_us": x} for x in (t - MIN, t - MIN + 1, t)]
    df = rows_to_df(spark, rows).withColumn("hybrid_label", F.lit("FAILURE"))
    last = {r["seq"]: r["failures_1m"] for r in trends.failures_last_minute(df).collect()}
    assert last[2] == 2


def test_trends_without_label(spark):
    row = trends.add_failure_trends(rows_to_df(spark, [{"ts_us": T0}])).first()
    assert row["trend_slope_5m"] == 0.0 and row["trend_variance_10m"] == 0.0


def test_order_of_input_does_not_matter(spark):
    rows = random_rows(200, seed=3)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    a = windows.frame_features(rows_to_df(spark, rows)).drop("timestamp").collect()
    b = windows.frame_features(rows_to_df(spark, shuffled)).drop("timestamp").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


@pytest.mark.parametrize("slice_us", [1_000_000, MIN, 5 * MIN, 10**12])
def test_fill_counter_and_lags_across_slices(spark, slice_us):
    rows = random_rows(300, seed=5)
    df = rows_to_df(spark, rows)
    filled = history.forward_fill(df, ["ram_percent", "gc_count"], slice_us)
    total = history.running_total(df, F.col("log_message").contains("lost"), "lost", slice_us)
    clamped = history.row_lag(df, "cpu_percent", 9, "old", slice_us, clamp=True)
    strict = history.row_lag(df, "cpu_percent", 3, "old", slice_us)
    before = history.previous_rows(df, F.col("seq"), 3, "prev", slice_us)
    want_fill, want_total, want_clamped, want_strict, want_prev = {}, {}, {}, {}, {}
    for service_rows in by_service(rows).values():
        ram = gc = None
        lost = 0
        for i, r in enumerate(service_rows):
            ram = r["ram_percent"] if r["ram_percent"] is not None else ram
            gc = r["gc_count"] if r["gc_count"] is not None else gc
            lost += "lost" in r["log_message"]
            want_fill[r["seq"]] = {"ram_percent": ram, "gc_count": gc}
            want_total[r["seq"]] = {"lost": lost}
            want_clamped[r["seq"]] = {"old": service_rows[max(0, i - 9)]["cpu_percent"]}
            want_strict[r["seq"]] = {"old": service_rows[i - 3]["cpu_percent"] if i >= 3 else None}
            want_prev[r["seq"]] = {"prev": [x["seq"] for x in service_rows[max(0, i - 3):i]]}
    check(filled, want_fill)
    check(total, want_total)
    check(clamped, want_clamped)
    check(strict, want_strict)
    check(before, want_prev)


def test_window_ids_follow_services_then_time(spark):
    rows = random_rows(200, seed=9)
    df = rows_to_df(spark, rows)
    frames = windows.frame_features(df)
    got = windows.number_windows(frames, df, Settings(slice_minutes=1), start=5)
    ids = {r["seq"]: r["window_id"] for r in got.collect()}
    first = sorted(by_service(rows).items(), key=lambda kv: (kv[1][0]["ts_us"], kv[1][0]["seq"]))
    kept = frame_reference(rows, 5 * MIN)
    order = [r["seq"] for _, service_rows in first for r in service_rows if r["seq"] in kept]
    assert ids == {seq: i for i, seq in enumerate(order, 5)}


def test_gc_jump_uses_ten_rows(spark):
    rows = [{"ts_us": T0 + i * 1_000_000, "gc_count": i} for i in range(12)]
    got = {r["seq"]: r["gc_jump"] for r in classify.gc_jump(rows_to_df(spark, rows)).collect()}
    assert [got[i] for i in range(12)] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9]


def test_single_service_ram_std_trend(spark):
    rows = [{"ts_us": T0 + i} for i in range(5)]
    df = rows_to_df(spark, rows).withColumn("ram_std", F.col("seq") * 3.0)
    got = {r["seq"]: r["ram_std_trend"] for r in trends.add_ram_std_trend(df).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 3.0, 4: 3.0}


def test_service_major_plans_split_by_time(spark):
    """No exchange and no window over rows is keyed by the service alone."""
    df = rows_to_df(spark, random_rows(50))
    plan = windows.frame_features(df)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert keys and all(k.startswith("service_name") and "_block" in k for k in keys)


def test_duplicates_are_limited_before_the_shuffle(spark):
    plan = preprocess.drop_duplicates(rows_to_df(spark, random_rows(20)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_slice_summaries_need_no_sort(spark):
    plan = history.forward_fill(rows_to_df(spark, random_rows(20)), ["ram_percent"], MIN)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_position_orders_like_time_then_seq(spark):
    rows = [(5, 2), (5, 1), (4, (1 << 62)), (None, 0), (None, 3), (T0 * 1000, 1)]
    df = spark.createDataFrame(rows, "ts_us bigint, seq bigint")
    got = [(r[0], r[1]) for r in df.orderBy(history.position()).collect()]
    assert got == [(4, 1 << 62), (5, 1), (5, 2), (T0 * 1000, 1), (None, 0), (None, 3)]
