"""Steps that were mended because their time grew with the rows."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from failwatch.functions import text
from failwatch.operators import classify, history
from failwatch.settings import MINUTE_US
from registry import jobs_catalog

MIN = MINUTE_US


def test_an_arrival_is_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(jobs_catalog, "ARRIVAL_ROWS", 20)
    # The second quarter of the time holds a single row, so most of its files are empty.
    times = [*range(0, 100), 1_500, *range(2_000, 2_100), *range(3_900, 4_000)]
    rows = spark.createDataFrame([(i, t * MIN) for i, t in enumerate(times)], "seq bigint, ts_us bigint")
    path, files = jobs_catalog._arriving(rows)
    written = sorted((os.stat(f"{path}/{f}").st_mtime_ns, f) for f in os.listdir(path) if f.startswith("part-"))
    assert files == 4 and len(written) == files * jobs_catalog.FILES
    arrivals = []
    for i in range(jobs_catalog.FILES):
        mine = [f"{path}/{f}" for _, f in written[i * files:(i + 1) * files]]
        arrivals.append({r["seq"] for r in spark.read.schema(rows.schema).parquet(*mine).collect()})
    assert [len(a) for a in arrivals] == [100, 1, 100, 100]
    assert set.union(*arrivals) == set(range(len(times)))


def test_few_rows_arrive_as_one_file(spark):
    rows = spark.createDataFrame([(i, i * MIN) for i in range(40)], "seq bigint, ts_us bigint")
    assert jobs_catalog._arriving(rows)[1] == 1


def test_fill_compares_no_positions(spark):
    rows = [("a", 0, 1, 5.0), ("a", 0, 2, None), ("a", MIN, 3, None), ("a", 5 * MIN, 4, 7.0), ("a", None, 5, None),
            (None, 0, 6, None), (None, 0, 7, 3.0), (None, MIN, 8, None), ("b", 0, 9, None), ("b", 2 * MIN, 10, float("nan"))]
    df = spark.createDataFrame(rows, "service_name string, ts_us bigint, seq bigint, ram_percent double")
    filled = history.forward_fill(df, ["ram_percent"], MIN)
    assert "decimal" not in filled._jdf.queryExecution().optimizedPlan().toString()
    got = {r["seq"]: str(r["ram_percent"]) for r in filled.collect()}
    assert got == {1: "5.0", 2: "5.0", 3: "5.0", 4: "7.0", 5: "7.0", 6: "None", 7: "None", 8: "None", 9: "None", 10: "nan"}
    assert filled.columns == df.columns


def test_phrases_are_searched_once_a_row(spark):
    rows = [("ERROR out of memory", 0.0, 0), ("cpu spike", 0.9, 3), ("fine", 0.9, 0), ("fine", 0.0, 3), (None, None, None)]
    fused = classify.fuse(spark.createDataFrame(rows, "log_template string, similarity double, metric_score int"))
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MEMORY LEAK") == 1
    got = [tuple(r)[3:] for r in fused.collect()]
    assert got == [
        ("FAILURE", "keyword", "memory_leak"), ("FAILURE", "keyword_metric_confirmed", "cpu_spike"),
        ("FAILURE", "tfidf_semantic", "none"), ("FAILURE", "metric_fusion", "metric_only"), ("NORMAL", "normal", "none"),
    ]


def test_blank_and_tokens(spark):
    rows = [(None,), ("",), (" \t\n\x0b\f\r",), (" a  b ",), (" ",)]
    df = spark.createDataFrame(rows, "m string")
    got = [tuple(r) for r in df.select(text.is_blank(F.col("m")), text.tokens(F.col("m"))).collect()]
    assert got == [(True, None), (True, []), (True, []), (False, ["a", "b"]), (False, [" "])]
