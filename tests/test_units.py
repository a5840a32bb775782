"""Hand-computed edges of the row-wise operators, reports and sources."""

from __future__ import annotations

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from failwatch import settings as S
from failwatch.functions import metrics, text
from failwatch.operators import classify, enrich, evaluate, preprocess, serve, sweeps, trends
from failwatch.schemas import AUDIT_COLUMNS, ML_COLUMNS, SAMPLE_COLUMNS, WINDOW_COLUMNS
from failwatch.sources import container, samples as sources
from failwatch.storage import materialize
from tests.fixtures import MIN, T0, close, random_rows, rows_to_df


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_column_counts():
    assert (len(SAMPLE_COLUMNS), len(WINDOW_COLUMNS), len(AUDIT_COLUMNS), len(ML_COLUMNS)) == (11, 25, 24, 25)
    assert (len(S.MEMORY_PHRASES), len(S.CPU_PHRASES)) == (19, 5)


def test_detect_stack(spark):
    tags = ["Python:3", "my/flask-node", "node:20", "x/JAVA", "spring", "aspnet", "golang", "lib/go", "go:1", "cargo:1", None]
    assert column(spark, tags, text.detect_stack) == [
        "Python/Flask", "Python/Flask", "Node.js/Express", "Java/SpringBoot", "Java/SpringBoot", ".NET/Core",
        "Go/net_http", "Go/net_http", "Go/net_http", "Unknown", "Unknown",
    ]


def test_detect_level_and_gc_words(spark):
    lines = ["fatal error", "a ROOM", "an exception", "warned", "fine", "Garbage", "egco"]
    assert column(spark, lines, text.detect_log_level) == ["CRITICAL", "ERROR", "ERROR", "WARNING", "INFO", "INFO", "INFO"]
    assert column(spark, lines, text.has_gc_word) == [False, False, False, False, False, True, True]


def test_clean_message(spark):
    values = ["a_b-<*> [x] err:1.2 | OOM!", "@#!", "  x  "]
    assert column(spark, values, text.clean_message) == ["ab [x] err:1.2  OOM", "", "x"]


def test_blank_is_any_white_space(spark):
    assert column(spark, [None, "", " \t\n", "x"], text.is_blank) == [True, True, True, False]


def test_clip_keeps_null(spark):
    values = [-1.0, 101.0, 50.0, None]
    assert column(spark, values, lambda c: metrics.clip(c, 0.0, 100.0), "double") == [0.0, 100.0, 50.0, None]


def test_keyword_memory_wins(spark):
    values = ["cpu spike and out of memory", "thread pool exhausted", "MEMORYLEAK", "fine"]
    assert column(spark, values, text.keyword_type) == ["memory_leak", "cpu_spike", None, None]


def test_words_and_bigrams(spark):
    got = column(spark, ["A cat, b2 <*> x_y", "solo", "a b", ""], lambda c: text.with_bigrams(text.words(c)))
    assert got == [["cat", "b2", "x_y", "cat b2", "b2 x_y"], ["solo"], [], []]


def test_duplicates_keep_the_first(spark):
    rows = [{"ts_us": T0, "ram_percent": 1.0}, {"ts_us": T0, "ram_percent": 2.0}, {"ts_us": T0, "log_message": "other"}]
    got = preprocess.drop_duplicates(rows_to_df(spark, rows[::-1]).withColumn("seq", 2 - F.col("seq"))).collect()
    assert sorted((r["seq"], r["ram_percent"]) for r in got) == [(0, 1.0), (2, 50.0)]


def test_fill_runs_before_blank_rows_go(spark):
    rows = [
        {"ts_us": T0, "ram_percent": None},
        {"ts_us": T0 + 1, "ram_percent": 33.0, "log_message": " "},
        {"ts_us": T0 + 2, "ram_percent": None, "log_message": "!!"},
        {"ts_us": T0 + 3, "ram_percent": 250.0, "service_name": None},
    ]
    got = {r["seq"]: r for r in preprocess.preprocess(rows_to_df(spark, rows)).collect()}
    assert set(got) == {0, 2, 3}
    assert got[0]["ram_percent"] is None and got[2]["ram_percent"] == 33.0
    assert got[2]["log_message"] == ""
    assert got[3]["ram_percent"] is None  # rows without a service are not filled


def test_quality_report(spark):
    rows = [
        {"ts_us": T0, "ram_percent": 120.0}, {"ts_us": T0, "ram_percent": 1.0},
        {"ts_us": T0 + 1, "ram_percent": None}, {"ts_us": T0 + 2, "log_message": ""},
    ]
    assert preprocess.quality_report(rows_to_df(spark, rows)).first().asDict() == {
        "rows_before": 4, "rows_removed": 2, "nulls_filled": 1, "outliers_clipped": 2,
    }


@pytest.mark.parametrize(
    "template,similarity,score,expected",
    [
        ("out of memory", 0.9, 1, ("FAILURE", "keyword", "memory_leak")),
        ("out of memory", 0.9, 2, ("FAILURE", "keyword_metric_confirmed", "memory_leak")),
        ("cpu spike", 0.0, 3, ("FAILURE", "keyword_metric_confirmed", "cpu_spike")),
        ("quiet", 0.1201, 1, ("FAILURE", "tfidf_semantic", "none")),
        ("quiet", 0.1201, 2, ("FAILURE", "tfidf_semantic_metric_confirmed", "none")),
        ("quiet", 0.12, 2, ("NORMAL", "normal", "none")),
        ("quiet", None, 3, ("FAILURE", "metric_fusion", "metric_only")),
    ],
)
def test_fusion(spark, template, similarity, score, expected):
    df = spark.createDataFrame(
        [(template, similarity, score)], "log_template string, similarity double, metric_score int"
    )
    assert tuple(classify.fuse(df).select("hybrid_label", "detection_layer", "failure_type").first()) == expected


def test_metric_points(spark):
    df = spark.createDataFrame(
        [(0, 75.0, 80.0, 350.0), (1, 75.1, 80.1, 350.1), (2, None, None, None), (3, 60.1, 0.0, 280.1)],
        "i int, ram_percent double, cpu_percent double, heap_mb_used double",
    )
    got = [r[0] for r in df.orderBy("i").select(metrics.metric_points(F.lit(4))).collect()]
    assert got == [1 + 1 + 2, 3 + 3 + 2 + 2, 2, 1 + 1 + 2]


def test_tfidf_equals_formula(spark):
    bodies = ["memory heap usage increasing", "request served fast", "heap heap space", "zz"]
    df = spark.createDataFrame([(b,) for b in bodies], "log_template string")
    got = {r["log_template"]: r["similarity"] for r in classify.fit_similarity(df).collect()}
    docs = bodies + S.FAILURE_SENTENCES

    def counts(d):
        w = [x for x in d.split() if len(x) > 1]
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        return {t: terms.count(t) for t in terms}

    tf = [counts(d) for d in docs]
    idf = {t: math.log((1 + len(docs)) / (1 + sum(t in c for c in tf))) + 1 for c in tf for t in c}
    vectors = []
    for c in tf:
        v = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    for i, b in enumerate(bodies):
        want = max(sum(w * r.get(t, 0.0) for t, w in vectors[i].items()) for r in vectors[len(bodies):])
        assert close(got[b], want, 1e-12)


def test_vocabulary_limit(spark):
    df = spark.createDataFrame([("aa aa bb cc",), ("aa dd",)], "log_template string")
    model = classify.fit_terms(df, settings=S.Settings(vocabulary_size=3))
    assert model.vocabulary.count() == 3


def test_vocabulary_writes_no_template_text(spark, monkeypatch):
    """terms are added up without their templates, whose text made every row of a term large."""
    written = []
    monkeypatch.setattr(classify, "materialize", lambda df, name="table": written.append(df.columns) or materialize(df, name))
    bodies = ["aa bb aa bb", "aa", "bb cc", ""]
    model = classify.fit_terms(spark.createDataFrame([(b,) for b in bodies], "log_template string"))
    assert not [c for c in written if "log_template" in c]
    n = len(bodies) + len(S.FAILURE_SENTENCES)
    idf = {r["term"]: r["idf"] for r in model.vocabulary.collect()}
    for term, df in {"aa": 2, "bb": 2, "cc": 1, "aa bb": 1, "bb aa": 1, "bb cc": 1}.items():
        assert close(idf[term], math.log((1 + n) / (1 + df)) + 1, 1e-12), term


STATS = {
    "cpu_stats": {"cpu_usage": {"total_usage": 300, "percpu_usage": [1, 1]}, "system_cpu_usage": 1000},
    "precpu_stats": {"cpu_usage": {"total_usage": 100}, "system_cpu_usage": 600},
    "memory_stats": {"usage": 1048576, "limit": 4194304},
}


def stats(**changes):
    record = json.loads(json.dumps(STATS))
    for path, value in changes.items():
        *parents, leaf = path.split("__")
        node = record
        for p in parents:
            node = node[p]
        if value is None:
            del node[leaf]
        else:
            node[leaf] = value
    return json.dumps(record)


@pytest.mark.parametrize(
    "record,expected",
    [
        (stats(), (True, 100.0, 25.0, 1.0)),
        (stats(cpu_stats__cpu_usage__percpu_usage=[]), (True, 50.0, 25.0, 1.0)),
        (stats(cpu_stats__cpu_usage__percpu_usage=None), (True, 50.0, 25.0, 1.0)),
        (stats(cpu_stats__system_cpu_usage=600), (True, 0.0, 25.0, 1.0)),
        (stats(cpu_stats__system_cpu_usage=None, precpu_stats__system_cpu_usage=None), (True, 0.0, 25.0, 1.0)),
        (stats(memory_stats__limit=0), (True, 100.0, 0.0, 1.0)),
        (stats(memory_stats__usage=None), (False, None, None, None)),
        ("not json", (False, None, None, None)),
    ],
)
def test_container_stats(spark, record, expected):
    df = container.parse_stats(spark.createDataFrame([(record,)], "stats string"))
    assert tuple(df.select("stats_ok", "cpu_percent", "ram_percent", "heap_mb_used").first()) == expected


def test_last_lines(spark):
    lines = [("x", i, f"l{i}") for i in range(5)] + [("y", 0, "only"), ("y", 1, "two")]
    df = spark.createDataFrame(lines, "tick string, line_no bigint, line string")
    got = {r["tick"]: r["log_message"] for r in container.last_lines(df, ["tick"]).collect()}
    assert got == {"x": "l2 | l3 | l4", "y": "only | two"}


def test_container_without_lines(spark):
    s = spark.createDataFrame(
        [(0, T0, "web", "node:20", stats())], "seq bigint, ts_us bigint, name string, image_tag string, stats string"
    )
    lines = spark.createDataFrame([], "ts_us bigint, name string, line_no bigint, line string")
    row = container.container_samples(s, lines).first()
    assert (row["log_message"], row["log_level"], row["gc_count"], row["ground_truth_label"]) == ("", "INFO", 0, "UNKNOWN")


@pytest.mark.parametrize(
    "before,expected",
    [
        (-1, ("FAILURE", 1, 1, "leak")), (0, ("PRE_FAILURE", 1, 1, "leak")), (300, ("PRE_FAILURE", 1, 1, "leak")),
        (301, ("NORMAL", 1, 0, "")), (420, ("NORMAL", 1, 0, "")), (421, ("NORMAL", 0, 0, "")),
    ],
)
def test_incident_phases(spark, before, expected):
    rows = rows_to_df(spark, [{"ts_us": T0 - before * 1_000_000}])
    columns = ["label", "incident_phase_1", "incident_phase_2", "failure_type"]
    one = enrich.label_incident_phases(rows, F.timestamp_micros(F.lit(T0)), "p", "leak")
    table = spark.createDataFrame([("p", "leak")], "project_id string, failure_type string").withColumn(
        "failure_ts", F.timestamp_micros(F.lit(T0))
    )
    many = enrich.label_incidents(rows.withColumn("project_id", F.lit("p")), table)
    assert tuple(one.select(*columns).first()) == expected
    assert tuple(many.select(*columns).first()) == expected


def test_incidents_of_a_slot_are_not_gathered(spark):
    """a row looked through all incidents of its slot, so the work grew with the square of the rows."""
    rng = random.Random(5)
    at = lambda: T0 + rng.randrange(60 * 60) * 1_000_000
    told = [(rng.choice(["p", "q", None]), at(), rng.choice(["leak", "spike"])) for _ in range(40)] + [("p", None, "leak")]
    times = [(rng.choice(["p", "q", "r", None]), None if i % 9 == 0 else at()) for i in range(200)]
    table = spark.createDataFrame(told, "project_id string, at bigint, failure_type string").withColumn("failure_ts", F.timestamp_micros("at"))
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(times)], "i int, project_id string, ts_us bigint")
    found = enrich.label_incidents(rows, table)
    assert "collect_set" not in found._jdf.queryExecution().toString()
    got = {r["i"]: (r["label"], r["failure_type"]) for r in found.collect()}
    assert len(got) == len(times)
    for i, (project, t) in enumerate(times):
        mine = sorted((a, k) for p, a, k in told if p == project and p and a is not None)
        ahead = [m for m in mine if t is not None and t <= m[0]]
        near = ahead[0] if ahead else mine[-1] if mine and t is not None else None
        left = near and (near[0] - t) / 1_000_000
        label = "NORMAL" if left is None else "FAILURE" if left < 0 else "PRE_FAILURE" if left <= 300 else "NORMAL"
        assert got[i] == (label, near[1] if label != "NORMAL" else ""), (i, project, t)


def test_incident_lookup_leaves_out_unread_columns(spark):
    table = spark.createDataFrame([("p", "leak")], "project_id string, failure_type string").withColumn("failure_ts", F.timestamp_micros(F.lit(T0)))
    rows = rows_to_df(spark, [{"ts_us": T0}]).withColumns({"project_id": F.lit("p"), "unread": F.raise_error(F.lit("read"))})
    found = enrich.label_incidents(rows, table)
    assert found.columns == ["project_id", *[c for c in rows.columns if c not in ("project_id", "failure_type")],
                             "label", "incident_phase_1", "incident_phase_2", "failure_type"]
    assert found.select("seq", "label").first()["label"] == "PRE_FAILURE"


def labelled(spark, pairs):
    rows = [{"ts_us": T0 + i} for i in range(len(pairs))]
    df = rows_to_df(spark, rows).drop("ground_truth_label")
    extra = spark.createDataFrame(
        [(i, t, p, "normal") for i, (t, p) in enumerate(pairs)],
        "seq bigint, ground_truth_label string, hybrid_label string, detection_layer string",
    )
    return df.join(extra, "seq")


def test_scores_of_one_class(spark):
    row = evaluate.overall(labelled(spark, [("NORMAL", "NORMAL")] * 3)).first()
    assert (row["tn"], row["precision"], row["recall"], row["f1"]) == (3, 0.0, 0.0, 0.0)
    assert serve.f1_per_service(labelled(spark, [("NORMAL", "FAILURE")])).first()["f1"] == 0.0


def test_scores(spark):
    F_, N = "FAILURE", "NORMAL"
    row = evaluate.overall(labelled(spark, [(F_, F_), (F_, F_), (N, F_), (F_, N), (N, N)])).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (2, 1, 1, 1)
    assert close(row["f1"], 2 / 3) and close(row["precision"], 2 / 3) and close(row["recall"], 2 / 3)


def test_early_warning_is_strictly_before(spark):
    rows = [{"ts_us": T0}, {"ts_us": T0}, {"ts_us": T0 + MIN}, {"ts_us": T0 + 2 * MIN, "service_name": "b"}]
    extra = spark.createDataFrame(
        [(0, "NORMAL", "FAILURE"), (1, "FAILURE", "FAILURE"), (2, "FAILURE", "NORMAL"), (3, "FAILURE", "FAILURE")],
        "seq bigint, ground_truth_label string, hybrid_label string",
    )
    df = rows_to_df(spark, rows).drop("ground_truth_label").join(extra, "seq")
    got = {r["seq"]: (r["warning_min"], r["predicted_early"]) for r in evaluate.early_warnings(df).collect()}
    assert got == {1: (None, False), 2: (1.0, True), 3: (None, False)}


@pytest.mark.parametrize("n", [1, 2, 7, 100, 301])
def test_exact_median(spark, n):
    rng = random.Random(n)
    values = [rng.choice([5, rng.randrange(10_000_000)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x bigint")
    assert evaluate.exact_median(df, "x", "m").first()["m"] == statistics.median(values)


@pytest.mark.parametrize("kind", ["spread", "skewed", "ties", "halves", "sorted"])
def test_exact_median_of_many_values(spark, kind):
    """More values than the sketch keeps, in partitions of unlike values."""
    n = 300_001 if kind != "halves" else 300_000
    value = {
        "spread": F.xxhash64("id"), "skewed": F.floor(F.pow(F.lit(1.0001), F.col("id") % 200_000)), "ties": F.floor(F.col("id") / 120_000) * 7,
        "halves": F.when(F.col("id") < 150_000, -5).otherwise(9), "sorted": F.col("id") * 3 - 1000,
    }[kind]
    df = spark.range(0, n, 1, 12).select(value.cast("long").alias("x"))
    want = statistics.median(df.toPandas()["x"].tolist())
    assert evaluate.exact_median(df, "x", "m").first()["m"] == pytest.approx(want, rel=1e-12)


def test_width_sweep_equals_scan(spark):
    rows = random_rows(200, seed=2)
    extra = spark.createDataFrame([(r["seq"], r["hybrid_label"]) for r in rows], "seq bigint, hybrid_label string")
    got = sweeps.window_width_sweep(rows_to_df(spark, rows).join(extra, "seq"), [1, 2, 5, 9]).collect()
    for r in got:
        width = r["window_minutes"] * MIN
        kept = [
            x for x in rows
            if sum(y["service_name"] == x["service_name"] and x["ts_us"] - width <= y["ts_us"] < x["ts_us"] for y in rows) >= 3
        ]
        assert r["total_windows"] == len(kept)
        assert r["failure_windows"] == sum(x["ground_truth_label"] == "FAILURE" for x in kept)


def test_label_fallback(spark):
    df = rows_to_df(spark, [{"ts_us": T0}])
    assert trends.with_label_fallback(df).first()["hybrid_label"] == "NORMAL"
    assert trends.with_label_fallback(df.withColumn("label", F.lit("X"))).first()["hybrid_label"] == "X"


def test_latest_ignores_missing_time(spark):
    rows = [{"ts_us": T0}, {"ts_us": T0}, {"ts_us": None}]
    got = serve.latest_per_service(rows_to_df(spark, rows)).collect()
    assert [r["seq"] for r in got] == [1]
    assert "hybrid_label" in got[0]


def test_records(spark):
    df = spark.sql("SELECT double('NaN') AS a, cast(null AS int) AS b, timestamp'2024-01-02 03:04:05' AS t, 'x' AS s")
    assert json.loads(serve.to_records(df).first()[0]) == {"a": None, "b": None, "t": "2024-01-02T03:04:05", "s": "x"}


def test_limits(spark):
    df = rows_to_df(spark, [{"ts_us": T0 + i} for i in range(5)])
    assert [r["seq"] for r in serve.latest_windows(df, 2).collect()] == [4, 3]
    with pytest.raises(ValueError):
        serve.latest_windows(df, 0)


def test_csv_keeps_bad_times_as_null(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(
        ",".join(SAMPLE_COLUMNS) + "\n"
        "2024-01-01 00:00:01.5,a,x,INFO,hello,1.0,2.0,3.0,4,NORMAL,none\n"
        "broken,a,x,INFO,hello,,nan,3.0,4,NORMAL,none\n"
    )
    rows = sources.read_csv(spark, str(path)).orderBy("seq").collect()
    assert [r["ts_us"] for r in rows] == [T0 + 1_500_000, None]
    assert rows[1]["ram_percent"] is None and rows[1]["cpu_percent"] is None
    with pytest.raises(Exception):
        sources.read_csv(spark, str(tmp_path / "absent.csv")).count()


def test_empty_samples(spark):
    empty = sources.empty_samples(spark)
    assert empty.count() == 0 and empty.columns == [*SAMPLE_COLUMNS, "ts_us", "seq"]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_files_are_ordered_by_name_not_by_size(spark, tmp_path, kind):
    """The larger file comes last by name, and is scanned first."""
    from failwatch.schemas import SAMPLE_COLUMNS

    def rows(ram, n):
        return spark.range(n).coalesce(1).selectExpr(
            "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as timestamp", "'s' as service_name",
            "'x' as stack", "'INFO' as log_level", "repeat('m', 20) as log_message", f"{ram}D as ram_percent", "1D as cpu_percent",
            "1D as heap_mb_used", "1L as gc_count", "'NORMAL' as ground_truth_label", "'none' as failure_type",
        ).select(*SAMPLE_COLUMNS)

    folder = tmp_path / "in"
    for name, df in (("part 0", rows(1, 3)), ("part 1", rows(99, 2000))):
        df.write.option("header", True).format(kind).save(str(tmp_path / name))
        folder.mkdir(exist_ok=True)
        found = next(p for p in (tmp_path / name).iterdir() if p.name.startswith("part-"))
        (folder / f"{name}.{kind}").write_bytes(found.read_bytes())
    read = sources.read_csv if kind == "csv" else sources.read_parquet
    got = read(spark, str(folder)).orderBy("seq").select("ram_percent", "ts_us").collect()
    assert [r.ram_percent for r in got] == [1.0] * 3 + [99.0] * 2000
    assert [r.ts_us for r in got[3:]] == sorted(r.ts_us for r in got[3:])
    first = preprocess.drop_duplicates(read(spark, str(folder))).where("ram_percent = 1")
    assert first.count() == 3


def test_latest_per_service_needs_no_sorted_aggregate(spark):
    rows = spark.createDataFrame([("a", 1, 1, 2.0)], "service_name string, ts_us bigint, seq bigint, ram_percent double")
    plan = serve.latest_per_service(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_project_ids_are_null_safe(spark, tmp_path):
    """Rows without a stack have one project id, in every micro-batch and in the ML table."""
    from failwatch.streaming.live import LiveJob

    live = LiveJob(spark, str(tmp_path / "out"), str(tmp_path / "state"))
    schema = "stack string, window_id bigint"
    batches = [[(None, 1), ("b", 2)], [(None, 3), ("c", 4)], [(None, 5), ("b", 6), ("d", 7)]]
    for batch, rows in enumerate(batches):
        ids = live._projects(spark.createDataFrame(rows, schema), batch - 1, batch)
    assert {r.stack: r.project_id for r in ids.collect()} == {None: "project_1", "b": "project_2", "c": "project_3", "d": "project_4"}
    assert ids.count() == 4
