"""Registered queries and their SQL oracles, one entry per operator of the survey."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from failwatch import settings as S
from failwatch.functions import metrics, text
from failwatch.operators import (
    classify, enrich, evaluate, preprocess, serve, sweeps, templates, trends, windows,
)
from failwatch.schemas import (
    AUDIT_COLUMNS, FEATURE_COLUMNS, FEED_COLUMNS, LIVE_COLUMNS, ML_COLUMNS, SAMPLE_COLUMNS,
    TREND_COLUMNS,
)
from failwatch.sinks import tables
from failwatch.sources import container, samples as sources
from failwatch.storage import materialize, new_path
from registry import adapter, oracle_parts as P
from registry.oracle_parts import r6

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(key: str, sql: str | None):
    def add(query: Query) -> Query:
        if key in ENTRIES:
            raise ValueError(f"{key} is registered twice")
        ENTRIES[key] = Entry(query, sql)
        return query

    return add


def sql(stage: str, final: str) -> str:
    return f"WITH {stage.strip()}\n{final.strip()}"


def out(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles at six decimals as in ``r6``."""
    picked = df.select(*columns) if columns else df
    return picked.select(
        *[
            (F.floor(F.col(f.name) * 1e6 + 0.5001) / 1e6).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name).cast("bigint").alias(f.name)
            if isinstance(f.dataType, T.IntegerType)
            else F.col(f.name)
            for f in picked.schema
        ]
    )


KEYS = ["service_name", "ts_us", "seq"]
KEY_LIST = ", ".join(KEYS)
METRICS = ["ram_percent", "cpu_percent", "heap_mb_used"]


def r6s(columns: list[str]) -> str:
    return ", ".join(r6(c, c) for c in columns)


# --------------------------------------------------------------------------- sources

@register("src1_csv_scan", sql(P.RAW, f"""
    SELECT row_number() OVER (PARTITION BY service_name, ts_us // 60000000 ORDER BY ts_us, seq) AS row_no, service_name, ts_us, stack, log_level, log_message,
           {r6s(METRICS)}, gc_count, ground_truth_label FROM raw"""))
def src1(spark, sf_dir):
    """Write the samples as CSV files in order, read them back with the declared schema.

    Rows are numbered within a service and minute by the reader's own order; messages hold
    blanks, quotes and commas."""
    path = new_path(spark, "samples")
    rows = adapter.samples(spark, sf_dir).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    quoted = F.when(F.col("log_message").startswith("ERROR"), F.concat(F.lit('a, "b" '), "log_message"))
    (
        rows.withColumn("log_message", F.coalesce(quoted, "log_message")).orderBy("ts_us", "seq").select(*SAMPLE_COLUMNS)
        .write.options(**tables.CSV).csv(path)
    )
    back = sources.read_csv(spark, path)
    order = Window.partitionBy("service_name", F.call_function("div", "ts_us", F.lit(60_000_000))).orderBy("seq")
    numbered = back.withColumn("row_no", F.row_number().over(order).cast("bigint"))
    plain = F.regexp_replace("log_message", '^a, "b" ', "")
    return out(numbered.withColumn("log_message", plain), "row_no", "service_name", "ts_us", "stack", "log_level",
               "log_message", *METRICS, "gc_count", "ground_truth_label")


@register("src2_rows_per_service", sql(P.RAW, "SELECT service_name, count(*) AS rows FROM raw GROUP BY 1"))
def src2(spark, sf_dir):
    return sources.rows_per_service(adapter.samples(spark, sf_dir))


_SHARE = lambda table, column: f"""
    SELECT {column}, count(*) AS rows, {r6('count(*) / sum(count(*)) OVER () * 100.0', 'percent')}
    FROM {table} GROUP BY 1"""


@register("src3_label_distribution", sql(P.RAW, _SHARE("raw", "ground_truth_label")))
def src3(spark, sf_dir):
    return out(classify.distribution(adapter.samples(spark, sf_dir), "ground_truth_label"))


@register("src4_container_metrics", sql(P.CONTAINER, f"SELECT seq, name, {r6s(METRICS)} FROM container_metrics"))
def src4(spark, sf_dir):
    parsed = container.parse_stats(adapter.container_stats(spark, sf_dir))
    return out(parsed.where("stats_ok"), "seq", "name", *METRICS)


@register("src4_rejected_records", sql(P.CONTAINER, """
    SELECT count(mem_usage) AS accepted, count(*) - count(mem_usage) AS rejected FROM containers"""))
def src4_rejects(spark, sf_dir):
    return container.reject_counts(container.parse_stats(adapter.container_stats(spark, sf_dir)))


@register("src5_last_log_lines", sql(P.LINES, "SELECT name, tick AS ts_us, log_message FROM last_lines"))
def src5(spark, sf_dir):
    return container.last_lines(adapter.log_lines(spark, sf_dir), ["name", "ts_us"])


@register("src6_detect_stack", sql(P.CONTAINER, f"SELECT seq, {P.STACK_OF('image_tag')} AS stack FROM containers"))
def src6(spark, sf_dir):
    return adapter.container_stats(spark, sf_dir).select(
        "seq", text.detect_stack(F.col("image_tag")).alias("stack")
    )


@register("src7_detect_log_level", sql(P.BASE, f"SELECT seq, {P.LEVEL('log_message')} AS log_level FROM base"))
def src7(spark, sf_dir):
    rows = adapter.samples(spark, sf_dir).where(F.col("seq") < adapter.COPY_SEQ)
    return rows.select("seq", text.detect_log_level(F.col("log_message")).alias("log_level"))


_GC = "regexp_matches(upper(d), 'GC|GARBAGE|COLLECTION')"


@register("src8_gc_words", sql("x AS (SELECT doc_id, text AS d FROM documents)", f"SELECT doc_id, {_GC} AS has_gc FROM x"))
def src8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.has_gc_word(F.col("text")).alias("has_gc"))


@register("src9_gc_counter", sql(P.BASE, f"""
    SELECT {KEY_LIST}, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (
        PARTITION BY service_name ORDER BY ts_us, seq)::BIGINT AS gc_count FROM base"""))
def src9(spark, sf_dir):
    e = adapter.events(spark, sf_dir)
    columns = adapter.sample_columns()
    message = F.when(F.col("event_type") == "signup", "full gc pause").otherwise("idle")
    rows = e.select(*[columns[k].alias(k) for k in KEYS], message.alias("log_message"))
    return container.gc_counter(rows).select(*KEYS, "gc_count")


@register("src10_container_samples", sql(
    P.CONTAINER + f"""{P.LINES.replace('base AS', ', base AS', 1)},
    ticked AS (SELECT *, ts_us - ts_us % 60000000 AS tick FROM container_metrics)""",
    f"""SELECT c.name AS service_name, c.tick AS ts_us, c.seq, {P.STACK_OF('image_tag')} AS stack, log_message,
        {P.LEVEL('log_message')} AS log_level, {r6s(METRICS)},
        sum(CASE WHEN regexp_matches(upper(log_message), 'GC|GARBAGE|COLLECTION') THEN 1 ELSE 0 END) OVER (
            PARTITION BY c.name ORDER BY c.tick, c.seq)::BIGINT AS gc_count,
        'UNKNOWN' AS ground_truth_label, 'none' AS failure_type
    FROM ticked c LEFT JOIN last_lines l ON c.name = l.name AND c.tick = l.tick"""))
def src10(spark, sf_dir):
    """All complete stats records, each with the last lines of its minute."""
    minute = F.col("ts_us") - F.pmod("ts_us", F.lit(60_000_000))
    records = adapter.container_stats(spark, sf_dir).withColumn("ts_us", minute)
    samples = container.container_samples(records, adapter.log_lines(spark, sf_dir))
    return out(samples, *KEYS, "stack", "log_message", "log_level", *METRICS, "gc_count",
               "ground_truth_label", "failure_type")


# --------------------------------------------------------------------- preprocessing

_RAW_ROW = f"{KEY_LIST}, log_message, {r6s(METRICS)}, gc_count"
RAW_COLUMNS = [*KEYS, "log_message", *METRICS, "gc_count"]


@register("pre1_drop_duplicates", sql(P.DEDUPED, f"SELECT {_RAW_ROW} FROM deduped"))
def pre1(spark, sf_dir):
    return out(preprocess.drop_duplicates(adapter.samples(spark, sf_dir)), *RAW_COLUMNS)


@register("pre2_forward_fill", sql(P.FILLED, f"SELECT {_RAW_ROW} FROM filled"))
def pre2(spark, sf_dir):
    return out(preprocess.fill_metrics(adapter.stages(spark, sf_dir).deduped), *RAW_COLUMNS)


@register("pre3_drop_blank_messages", sql(P.RAW, f"SELECT {_RAW_ROW} FROM raw WHERE trim(log_message) <> ''"))
def pre3(spark, sf_dir):
    return out(preprocess.drop_blank_messages(adapter.samples(spark, sf_dir)), *RAW_COLUMNS)


@register("pre4_clip_metrics", sql(P.RAW, f"""
    SELECT {KEY_LIST}, {', '.join(
        r6(f'CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {lo}), {hi}) END', c)
        for c, (lo, hi) in S.METRIC_BOUNDS.items())} FROM raw"""))
def pre4(spark, sf_dir):
    return out(preprocess.clip_metrics(adapter.samples(spark, sf_dir)), *KEYS, *METRICS)


@register("pre5_clean_messages", r"""
    SELECT doc_id, md5(trim(regexp_replace(text, '[^A-Za-z0-9 .:\[\]]+', '', 'g'))) AS message_md5 FROM documents""")
def pre5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("text", "log_message")
    return preprocess.clean_messages(docs).select("doc_id", F.md5("log_message").alias("message_md5"))


_NULLS = lambda t: " + ".join(f"(SELECT count(*) - count({c}) FROM {t})" for c in [*METRICS, "gc_count"])


@register("pre6_quality_report", sql(P.CLEANED, f"""
    SELECT (SELECT count(*) FROM raw) AS rows_before,
           (SELECT count(*) FROM raw) - (SELECT count(*) FROM cleaned) AS rows_removed,
           {_NULLS('deduped')} - ({_NULLS('filled')}) AS nulls_filled,
           (SELECT (count_if(ram_percent > 100 OR ram_percent < 0) + count_if(cpu_percent > 100 OR cpu_percent < 0)
              + count_if(heap_mb_used > 10000 OR heap_mb_used < 0))::BIGINT
            FROM filled WHERE trim(log_message) <> '') AS outliers_clipped"""))
def pre6(spark, sf_dir):
    return preprocess.quality_report(adapter.samples(spark, sf_dir))


@register("pre7_drop_untimed", sql(P.BASE, """
    SELECT seq, epoch_us(t) AS ts_us FROM (
      SELECT seq, try_cast(CASE WHEN seq % 13 = 0 THEN 'not a time' ELSE
        strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S.%f') END AS TIMESTAMP) AS t FROM base)
    WHERE t IS NOT NULL"""))
def pre7(spark, sf_dir):
    rows = adapter.samples(spark, sf_dir).where(F.col("seq") < adapter.COPY_SEQ)
    written = F.when(F.col("seq") % 13 == 0, "not a time").otherwise(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    parsed = rows.select("seq", F.try_to_timestamp(written).alias("timestamp"))
    return preprocess.drop_untimed(sources.with_order(sources.with_missing(parsed, METRICS))).select("seq", "ts_us")


@register("pre_all_preprocess", sql(P.CLEANED, f"SELECT {_RAW_ROW} FROM cleaned"))
def pre_all(spark, sf_dir):
    return out(adapter.stages(spark, sf_dir).cleaned, *RAW_COLUMNS)


# ------------------------------------------------------------------------- templates

@register("tpl1a_leaf_key", sql(P.CLEANED, r"""
    SELECT seq, len(t)::BIGINT AS n_tokens,
           CASE WHEN len(t) = 0 THEN '' WHEN regexp_matches(t[1], '\d') THEN '<*>' ELSE t[1] END AS first_token,
           array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '\d') THEN '<*>' ELSE x END), ' ') AS pattern
    FROM (SELECT seq, CASE WHEN log_message = '' THEN [] ELSE regexp_split_to_array(log_message, '\s+') END AS t FROM cleaned)"""))
def tpl1a(spark, sf_dir):
    keyed = templates.leaf_columns(adapter.stages(spark, sf_dir).cleaned)
    return out(keyed, "seq", "n_tokens", "first_token", "pattern")


@register("tpl3_template_count", sql(P.TEMPLATED, "SELECT count(DISTINCT log_template) AS templates FROM templated"))
def tpl3(spark, sf_dir):
    return templates.template_count(adapter.stages(spark, sf_dir).templated)


@register("tpl4_top_templates", sql(P.TEMPLATED, """
    SELECT substring(log_template, 1, 90) AS template, count(*) AS rows FROM templated
    GROUP BY log_template ORDER BY count(*) DESC, log_template LIMIT 10"""))
def tpl4(spark, sf_dir):
    return templates.most_frequent(adapter.stages(spark, sf_dir).templated)


@register("tpl5_templates_per_stack", sql(P.TEMPLATED, """
    SELECT stack, count(DISTINCT log_template) AS templates FROM templated GROUP BY 1"""))
def tpl5(spark, sf_dir):
    return templates.per_stack(adapter.stages(spark, sf_dir).templated)


# ------------------------------------------------------------------------ classifier

@register("cls1_keyword_layer", sql(P.TEMPLATED, f"""
    SELECT seq, CASE WHEN kind IS NOT NULL THEN 'FAILURE' END AS label,
           CASE WHEN kind IS NOT NULL THEN 'keyword' END AS layer, kind AS failure_type
    FROM (SELECT seq, {P.KEYWORD_TYPE} AS kind FROM templated)"""))
def cls1(spark, sf_dir):
    label, layer, kind = classify.keyword_layer(F.col("log_template"))
    return adapter.stages(spark, sf_dir).templated.select(
        "seq", label.alias("label"), layer.alias("layer"), kind.alias("failure_type")
    )


@register("cls2_tfidf_weights", sql(P.SIMILARITY, f"""
    SELECT doc AS log_template, term, {r6('weight', 'weight')} FROM weight WHERE side = 't'"""))
def cls2(spark, sf_dir):
    found = materialize(classify.distinct_templates(adapter.stages(spark, sf_dir).templated))
    return out(classify.term_weights(classify.fit_terms(found)), "log_template", "term", "weight")


@register("cls2_vocabulary_documents", r"""
    WITH lines AS (SELECT DISTINCT line AS log_template FROM (
        SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> ''),
    templated AS (SELECT log_template FROM lines),
    """ + P.similarity([10]).strip().replace("[a-z0-9_]{2,}", r"[\p{L}\p{N}_]{2,}") + f"""
    SELECT term, {r6('ln((1 + n) / (1 + df)) + 1', 'idf')} FROM vocab JOIN n_docs USING (size)""")
def cls2_documents(spark, sf_dir):
    """The vocabulary fitted on every line of the documents, a much larger corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(
        F.trim("line").alias("log_template")
    )
    found = materialize(classify.distinct_templates(lines.where(F.col("log_template") != "")))
    return out(classify.fit_terms(found).vocabulary, "term", "idf")


@register("cls3_similarity", sql(P.SIMILARITY, f"SELECT log_template, {r6('similarity', 'similarity')} FROM similarity"))
def cls3(spark, sf_dir):
    return out(adapter.stages(spark, sf_dir).similarity)


@register("cls4_semantic_layer", sql(P.SIMILARITY, """
    SELECT seq, CASE WHEN similarity > 0.12 THEN 'FAILURE' ELSE 'NORMAL' END AS label,
           CASE WHEN similarity > 0.12 THEN 'tfidf_semantic' ELSE 'normal' END AS layer
    FROM templated LEFT JOIN similarity USING (log_template)"""))
def cls4(spark, sf_dir):
    run = adapter.stages(spark, sf_dir)
    hit = classify.semantic_hit(F.col("similarity"), S.DEFAULTS.semantic_threshold)
    return run.templated.join(run.similarity, "log_template", "left").select(
        "seq",
        F.when(hit, "FAILURE").otherwise("NORMAL").alias("label"),
        F.when(hit, "tfidf_semantic").otherwise("normal").alias("layer"),
    )


@register("cls5_metric_points", sql(P.SCORED, f"SELECT seq, ({P.POINTS})::BIGINT AS points FROM scored"))
def cls5(spark, sf_dir):
    points = metrics.metric_points(F.lit(0))
    return out(adapter.stages(spark, sf_dir).templated.withColumn("points", points), "seq", "points")


@register("cls6_gc_jump", sql(P.SCORED, f"SELECT {KEY_LIST}, gc_jump, metric_score::BIGINT AS metric_score FROM scored"))
def cls6(spark, sf_dir):
    return out(classify.metric_score(adapter.stages(spark, sf_dir).templated), *KEYS, "gc_jump", "metric_score")


_LABELS = ["hybrid_label", "detection_layer", "failure_type"]


@register("cls7_fused_labels", sql(P.CLASSIFIED, f"SELECT {KEY_LIST}, {', '.join(_LABELS)} FROM classified"))
def cls7(spark, sf_dir):
    return adapter.stages(spark, sf_dir).classified.select(*KEYS, *_LABELS)


@register("cls8_label_distribution", sql(P.CLASSIFIED, _SHARE("classified", "hybrid_label")))
def cls8(spark, sf_dir):
    return out(classify.distribution(adapter.stages(spark, sf_dir).classified, "hybrid_label"))


@register("cls8_failure_type_distribution", sql(P.CLASSIFIED, _SHARE("classified", "failure_type")))
def cls8_types(spark, sf_dir):
    return out(classify.distribution(adapter.stages(spark, sf_dir).classified, "failure_type"))


# --------------------------------------------------------------------------- windows

def _frames(spark, sf_dir):
    return windows.frame_features(adapter.stages(spark, sf_dir).cleaned)


# The frame features do not need the labels, so these oracles stop at the cleaned rows.
FRAMES = P.CLEANED + P.WINDOWS[len(P.CLASSIFIED):].replace("FROM classified", "FROM cleaned")


def _window_entry(key: str, *columns: str) -> None:
    doubles = {*FEATURE_COLUMNS, "window_duration_seconds"} - {"gc_spike_count"}
    listed = ", ".join(r6(c, c) if c in doubles else c for c in columns)
    register(key, sql(FRAMES, f"SELECT {KEY_LIST}, {listed} FROM windows"))(
        lambda spark, sf_dir: out(_frames(spark, sf_dir), *KEYS, *columns)
    )


_window_entry("win1_trailing_frame", "window_rows")
_window_entry("win3_memory_growth", "memory_growth")
_window_entry("win4_heap_rate", "heap_rate")
_window_entry("win5_gc_spike_count", "gc_spike_count")
_window_entry("win6_statistics", "ram_mean", "ram_max", "ram_std", "cpu_mean", "cpu_max", "heap_max")
_window_entry("win7_duration", "window_duration_seconds")
_window_entry("win8_window_label", "window_label")


@register("win2_sparse_frames_per_service", sql(FRAMES, """
    SELECT service_name, count(*) AS windows, min(window_rows) AS fewest FROM windows GROUP BY 1"""))
def win2(spark, sf_dir):
    return _frames(spark, sf_dir).groupBy("service_name").agg(
        F.count("*").alias("windows"), F.min("window_rows").alias("fewest")
    )


_PASSED = ["service_name", "ts_us", "seq", "stack", "log_template", "template_id", *METRICS, "gc_count",
           *_LABELS, "ground_truth_label", "label_source"]


@register("win9_passed_columns", sql(P.WINDOWS, "SELECT " + ", ".join(
    r6(c, c) if c in METRICS else c for c in _PASSED) + " FROM windows"))
def win9(spark, sf_dir):
    return out(adapter.stages(spark, sf_dir).window_rows, *_PASSED)


@register("win10_window_id", sql(FRAMES, f"SELECT {KEY_LIST}, window_id FROM windows"))
def win10(spark, sf_dir):
    return _numbered(spark, sf_dir).select(*KEYS, "window_id")


@register("win11_window_summary", sql(FRAMES, f"""
    SELECT count(*) AS windows, {r6('avg(window_duration_seconds)', 'mean_duration_seconds')},
           min(window_rows) AS min_rows, max(window_rows) AS max_rows,
           count(*) FILTER (ground_truth_label = 'FAILURE') AS failure_windows,
           count(*) FILTER (ground_truth_label = 'NORMAL') AS normal_windows FROM windows"""))
def win11(spark, sf_dir):
    return out(windows.window_summary(_frames(spark, sf_dir)))


# ---------------------------------------------------------------- trends and enrichment

def _window_rows(spark, sf_dir):
    return adapter.stages(spark, sf_dir).window_rows


@register("trd1_failures_last_minute", sql(P.TRENDS, f"SELECT {KEY_LIST}, failures_1m FROM minute_counts"))
def trd1(spark, sf_dir):
    return trends.failures_last_minute(_window_rows(spark, sf_dir)).select(*KEYS, "failures_1m")


def _trend_entry(key: str, *columns: str) -> None:
    register(key, sql(P.TRENDS, f"SELECT {KEY_LIST}, {r6s(list(columns))} FROM trends"))(
        lambda spark, sf_dir: out(trends.add_failure_trends(_window_rows(spark, sf_dir)), *KEYS, *columns)
    )


_trend_entry("trd2_trend_max", "trend_max_failures_5m", "trend_max_failures_10m")
_trend_entry("trd3_trend_variance", "trend_variance_5m", "trend_variance_10m")
_trend_entry("trd4_trend_slope", "trend_slope_5m", "trend_slope_10m")
_trend_entry("trd5_failure_trends", *TREND_COLUMNS)


@register("trd6_ram_std_trend", sql(P.TRENDS, f"SELECT {KEY_LIST}, {r6('ram_std_trend', 'ram_std_trend')} FROM trends"))
def trd6(spark, sf_dir):
    return out(trends.add_ram_std_trend(_window_rows(spark, sf_dir)), *KEYS, "ram_std_trend")


@register("trd7_trend_report", sql(P.TRENDS, " UNION ALL ".join(
    f"SELECT {P.q(c)} AS trend, {r6(f'avg({c})', 'mean')}, {r6(f'max({c})', 'max')} FROM trends" for c in TREND_COLUMNS)))
def trd7(spark, sf_dir):
    return out(trends.trend_report(trends.add_failure_trends(_window_rows(spark, sf_dir))))


@register("trd8_label_fallback", sql(P.RAW, f"SELECT {KEY_LIST}, ground_truth_label AS hybrid_label FROM raw"))
def trd8(spark, sf_dir):
    rows = adapter.samples(spark, sf_dir).withColumnRenamed("ground_truth_label", "label")
    return trends.with_label_fallback(rows).select(*KEYS, "hybrid_label")


_FAILURE_US = adapter.BASE_US + 70 * 60_000_000
_PHASE = lambda d, kind: f"""
    CASE WHEN {d} < 0 THEN 'FAILURE' WHEN {d} <= 300000000 THEN 'PRE_FAILURE' ELSE 'NORMAL' END AS label,
    CASE WHEN {d} <= 420000000 THEN 1 ELSE 0 END AS incident_phase_1,
    CASE WHEN {d} <= 300000000 THEN 1 ELSE 0 END AS incident_phase_2,
    CASE WHEN {d} <= 300000000 THEN {kind} ELSE '' END AS failure_type"""
PHASES = ["label", "incident_phase_1", "incident_phase_2", "failure_type"]


@register("enr1_incident_phases", sql(P.RAW, f"""
    SELECT {KEY_LIST}, 'project_1' AS project_id, {_PHASE(f'({_FAILURE_US} - ts_us)', "'memory_leak'")} FROM raw"""))
def enr1(spark, sf_dir):
    labelled = enrich.label_incident_phases(
        adapter.samples(spark, sf_dir), F.timestamp_micros(F.lit(_FAILURE_US)), "project_1", "memory_leak"
    )
    return out(labelled, *KEYS, "project_id", *PHASES)


@register("enr1_incident_table", sql(P.RAW + """,
    incidents AS (
      SELECT service_name AS project_id, ts_us AS t,
             CASE WHEN seq % 2 = 0 THEN 'memory_leak' ELSE 'cpu_spike' END AS kind
      FROM base WHERE event_type = 'error' AND value > 100),
    ahead AS (SELECT r.seq, min(row(i.t, i.kind)) AS n FROM raw r JOIN incidents i
              ON i.project_id = r.service_name AND i.t >= r.ts_us GROUP BY r.seq),
    latest AS (SELECT project_id, max(row(t, kind)) AS n FROM incidents GROUP BY 1),
    nearest AS (
      SELECT r.*, coalesce(a.n[1], l.n[1]) - ts_us AS d, coalesce(a.n[2], l.n[2]) AS kind
      FROM raw r LEFT JOIN ahead a USING (seq) LEFT JOIN latest l ON l.project_id = r.service_name)""", f"""
    SELECT {KEY_LIST}, {_PHASE('d', 'kind')} FROM nearest"""))
def enr1_table(spark, sf_dir):
    rows = adapter.samples(spark, sf_dir).withColumn("project_id", F.col("service_name"))
    return out(enrich.label_incidents(rows, adapter.incidents(spark, sf_dir)), *KEYS, *PHASES)


@register("enr2_phase_counts", sql(P.RAW + f""",
    phased AS (SELECT {_PHASE(f'({_FAILURE_US} - ts_us)', "'memory_leak'")} FROM raw)""",
    "SELECT label, count(*) AS rows FROM phased GROUP BY 1"))
def enr2(spark, sf_dir):
    labelled = enrich.label_incident_phases(
        adapter.samples(spark, sf_dir), F.timestamp_micros(F.lit(_FAILURE_US)), "project_1", "memory_leak"
    )
    return labelled.groupBy("label").agg(F.count("*").alias("rows"))


_PROJECT = lambda by: sql(FRAMES, f"""
    SELECT {by}, 'project_' || row_number() OVER (ORDER BY min(window_id)) AS project_id FROM windows GROUP BY 1""")


def _numbered(spark, sf_dir):
    rows = adapter.stages(spark, sf_dir).cleaned
    frames = materialize(windows.frame_features(rows), "frames")
    return windows.number_windows(frames, rows)


@register("enr3_project_by_stack", _PROJECT("stack"))
def enr3(spark, sf_dir):
    return enrich.project_ids(_numbered(spark, sf_dir), "stack")


@register("enr4_project_by_service", _PROJECT("service_name"))
def enr4(spark, sf_dir):
    return enrich.project_ids(_numbered(spark, sf_dir), "service_name")


# ------------------------------------------------------------------------ evaluation

TRUE = "(ground_truth_label = 'FAILURE')"
PRED = "(hybrid_label = 'FAILURE')"


def _counts(pred: str = PRED, extra: str = "") -> str:
    return f"""count(*) FILTER ({TRUE} AND {pred}) AS tp, count(*) FILTER (NOT {TRUE} AND {pred}) AS fp,
    count(*) FILTER ({TRUE} AND NOT {pred}) AS fn, count(*) FILTER (NOT {TRUE} AND NOT {pred}) AS tn{extra}"""


PRECISION = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END"
RECALL = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END"
SCORES = f"{r6(PRECISION, 'precision')}, {r6(RECALL, 'recall')}, {r6(F1, 'f1')}"


@register("evl1_overall_scores", sql(P.WINDOWS, f"SELECT tp, fp, fn, tn, {SCORES} FROM (SELECT {_counts()} FROM windows)"))
def evl1(spark, sf_dir):
    return out(evaluate.overall(_window_rows(spark, sf_dir)))


_LAYERS = """count(*) FILTER (contains(detection_layer, 'keyword')) AS keyword,
    count(*) FILTER (contains(detection_layer, 'tfidf_semantic')) AS tfidf_semantic,
    count(*) FILTER (contains(detection_layer, 'metric_fusion')) AS metric_fusion"""


@register("evl2_layer_contribution", sql(P.WINDOWS, f"""
    SELECT *, {r6('tfidf_semantic / total_failures * 100.0', 'semantic_gain_percent')}
    FROM (SELECT count(*) AS total_failures, {_LAYERS} FROM windows WHERE {PRED})"""))
def evl2(spark, sf_dir):
    return out(evaluate.layer_contribution(_window_rows(spark, sf_dir)))


EVL3_SQL = sql(P.WINDOWS, f"""
    SELECT service_name, stack, {r6(F1, 'f1')} FROM (
      SELECT service_name, {_counts(extra=", arg_min(stack, (ts_us, seq)) AS stack")} FROM windows GROUP BY 1)""")


@register("evl3_f1_per_service", EVL3_SQL)
def evl3(spark, sf_dir):
    return out(evaluate.per_service(_window_rows(spark, sf_dir)))


@register("evl4_window_label_distribution", sql(FRAMES, _SHARE("windows", "ground_truth_label")))
def evl4(spark, sf_dir):
    return out(classify.distribution(_frames(spark, sf_dir), "ground_truth_label"))


@register("evl5_feature_ranges", sql(FRAMES, " UNION ALL ".join(
    f"SELECT {P.q(c)} AS feature, {r6(f'min({c})', 'min')}, {r6(f'avg({c})', 'mean')}, {r6(f'max({c})', 'max')} FROM windows"
    for c in FEATURE_COLUMNS)))
def evl5(spark, sf_dir):
    return out(evaluate.feature_ranges(_frames(spark, sf_dir)))


_LAYER_TESTS = [
    "contains(detection_layer, 'keyword')",
    "(contains(detection_layer, 'keyword') OR contains(detection_layer, 'tfidf'))",
    "contains(detection_layer, 'metric_fusion')",
    PRED,
]
ABLATION = P.WINDOWS + ", ablation AS (" + " UNION ALL ".join(
    f"SELECT {i} AS place, {P.q(m)} AS method, {_counts(t)} FROM windows"
    for i, (m, t) in enumerate(zip(evaluate.METHODS, _LAYER_TESTS))) + f"), scored_methods AS (SELECT *, {F1} AS f1v FROM ablation)"


@register("evl6_ablation", sql(ABLATION, f"SELECT method, tp, fp, fn, {SCORES} FROM ablation"))
def evl6(spark, sf_dir):
    return out(evaluate.ablation(_window_rows(spark, sf_dir)))


@register("evl7_best_method", sql(ABLATION, f"""
    SELECT method, {r6('f1v', 'f1')}, {r6('f1v - next', 'improvement')} FROM (
      SELECT *, lead(f1v) OVER (ORDER BY f1v DESC, place) AS next FROM scored_methods)
    ORDER BY f1v DESC, place LIMIT 1"""))
def evl7(spark, sf_dir):
    return out(evaluate.best_method(evaluate.ablation(_window_rows(spark, sf_dir))))


LOSO = P.WINDOWS + f", loso AS (SELECT stack, count(*) AS rows, {_counts()} FROM windows WHERE stack IS NOT NULL GROUP BY 1)"


@register("evl8_leave_one_stack_out", sql(LOSO, f"SELECT stack, {SCORES}, rows FROM loso"))
def evl8(spark, sf_dir):
    return out(evaluate.leave_one_stack_out(_window_rows(spark, sf_dir)))


@register("evl8_leave_one_stack_out_summary", sql(LOSO, f"""
    SELECT {r6('avg(f1v)', 'average_f1')},
           coalesce(string_agg(CASE WHEN f1v <= 0.70 THEN stack END, ', ' ORDER BY stack), '') AS underperforming
    FROM (SELECT stack, {F1} AS f1v FROM loso)"""))
def evl8_summary(spark, sf_dir):
    return out(evaluate.leave_one_stack_out_summary(_window_rows(spark, sf_dir)))


CORPUS_SWEEP = P.TEMPLATED + "," + P.similarity(S.CORPUS_SIZES) + f""",
    sweep AS (
      SELECT size, {_counts('(similarity > 0.12)')} FROM templated JOIN similarity USING (log_template) GROUP BY size),
    swept AS (SELECT size::BIGINT AS size, {SCORES} FROM sweep)"""


@register("evl9_corpus_size_sweep", sql(CORPUS_SWEEP, "SELECT * FROM swept"))
def evl9(spark, sf_dir):
    return out(sweeps.corpus_size_sweep(adapter.stages(spark, sf_dir).templated))


@register("evl9_best_corpus_size", sql(CORPUS_SWEEP, "SELECT * FROM swept ORDER BY f1 DESC, size LIMIT 1"))
def evl9_best(spark, sf_dir):
    return out(sweeps.best_of(sweeps.corpus_size_sweep(adapter.stages(spark, sf_dir).templated), "size"))


_WIDTHS = " UNION ALL ".join(f"""
    SELECT {m}::BIGINT AS window_minutes, ground_truth_label, hybrid_label, count(*) OVER (
      PARTITION BY service_name ORDER BY ts_us RANGE BETWEEN {m * 60_000_000} PRECEDING AND 1 PRECEDING) AS window_rows
    FROM classified""" for m in S.WINDOW_SWEEP_MINUTES)
WIDTH_SWEEP = P.CLASSIFIED + f""",
    framed AS ({_WIDTHS}),
    widths AS (SELECT window_minutes, count(*) AS total_windows, {_counts()} FROM framed WHERE window_rows >= 3 GROUP BY 1),
    swept AS (SELECT window_minutes, total_windows, tp + fn AS failure_windows,
      {r6('(tp + fn) / total_windows * 100.0', 'failure_percent')}, {r6(F1, 'f1')} FROM widths)"""


@register("evl10_window_width_sweep", sql(WIDTH_SWEEP, "SELECT * FROM swept"))
def evl10(spark, sf_dir):
    return out(sweeps.window_width_sweep(adapter.stages(spark, sf_dir).classified))


@register("evl10_best_window_width", sql(WIDTH_SWEEP, "SELECT * FROM swept ORDER BY f1 DESC, window_minutes LIMIT 1"))
def evl10_best(spark, sf_dir):
    return out(sweeps.best_of(sweeps.window_width_sweep(adapter.stages(spark, sf_dir).classified), "window_minutes"))


WARNINGS = P.WINDOWS + """,
    alerted AS (
      SELECT *, min(CASE WHEN hybrid_label = 'FAILURE' THEN ts_us END) OVER (
          PARTITION BY service_name ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS alert,
        first_value(stack IGNORE NULLS) OVER (PARTITION BY service_name ORDER BY ts_us, seq) AS first_stack
      FROM windows),
    warnings AS (
      SELECT service_name, first_stack AS stack, ts_us, seq, (ts_us - alert) / 60e6 AS warning_min,
             alert IS NOT NULL AS predicted_early
      FROM alerted WHERE ground_truth_label = 'FAILURE')"""


@register("evl12_early_warnings", sql(WARNINGS, f"""
    SELECT {KEY_LIST}, stack, {r6('warning_min', 'warning_min')}, predicted_early FROM warnings"""))
def evl12(spark, sf_dir):
    return out(evaluate.early_warnings(_window_rows(spark, sf_dir)), *KEYS, "stack", "warning_min", "predicted_early")


@register("evl13_early_warning_summary", sql(WARNINGS, f"""
    SELECT count(*) AS total_failures, count(*) FILTER (predicted_early) AS successful,
           count(*) FILTER (NOT predicted_early) AS missed,
           {r6('count(*) FILTER (predicted_early) / count(*) * 100.0', 'success_percent')},
           {r6('count(*) FILTER (NOT predicted_early) / count(*) * 100.0', 'missed_percent')},
           {r6('min(warning_min)', 'min_warning')}, {r6('max(warning_min)', 'max_warning')},
           {r6('avg(warning_min)', 'avg_warning')}, {r6('median(warning_min)', 'median_warning')}
    FROM warnings"""))
def evl13(spark, sf_dir):
    return out(evaluate.early_warning_summary(evaluate.early_warnings(_window_rows(spark, sf_dir))))


@register("evl14_early_warning_by_service", sql(WARNINGS, f"""
    SELECT service_name, stack, {r6('avg(warning_min)', 'avg_warning_min')} FROM warnings
    WHERE warning_min IS NOT NULL GROUP BY 1, 2"""))
def evl14(spark, sf_dir):
    return out(evaluate.early_warning_by_service(evaluate.early_warnings(_window_rows(spark, sf_dir))))


# --------------------------------------------------------------------------- serving

@register("api1_status", sql(FRAMES, """
    SELECT (SELECT count(*) FROM cleaned) AS total_rows, (SELECT count(*) FROM windows) AS total_windows,
           (SELECT string_agg(DISTINCT service_name, ',' ORDER BY service_name) FROM cleaned) AS active_services"""))
def api1(spark, sf_dir):
    rows = adapter.stages(spark, sf_dir).cleaned
    status = serve.status(rows, windows.frame_features(rows))
    return status.withColumn("active_services", F.array_join("active_services", ","))


_LIVE = [c for c in LIVE_COLUMNS if c != "timestamp"]


@register("api2_latest_per_service", sql(P.CLASSIFIED, f"""
    SELECT {', '.join(r6(c, c) if c in METRICS else c for c in _LIVE)}, ts_us FROM classified
    QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY ts_us DESC, seq DESC) = 1"""))
def api2(spark, sf_dir):
    return out(serve.latest_per_service(adapter.stages(spark, sf_dir).classified), *_LIVE, "ts_us")


@register("api3_latest_windows", sql(P.WINDOWS, f"""
    SELECT {KEY_LIST}, hybrid_label, {r6s(['memory_growth', 'ram_mean'])} FROM windows
    ORDER BY ts_us DESC, seq DESC LIMIT 50"""))
def api3(spark, sf_dir):
    return out(serve.latest_windows(_window_rows(spark, sf_dir), 50), *KEYS, "hybrid_label", "memory_growth", "ram_mean")


@register("api4_top_templates", sql(P.CLASSIFIED, f"""
    SELECT log_template AS template, count(*) AS count, bool_or({PRED}) AS failure_related
    FROM classified GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def api4(spark, sf_dir):
    return serve.top_templates(adapter.stages(spark, sf_dir).classified)


@register("api5_window_totals", sql(P.WINDOWS, f"""
    SELECT *, total_windows - failure_windows AS normal_windows,
           {r6('round(failure_windows / total_windows * 100.0, 2)', 'failure_percent')}
    FROM (SELECT count(*) AS total_windows, count(*) FILTER ({PRED}) AS failure_windows FROM windows)"""))
def api5(spark, sf_dir):
    return out(serve.window_totals(_window_rows(spark, sf_dir)))


@register("api6_layer_totals", sql(P.WINDOWS, f"SELECT {_LAYERS} FROM windows"))
def api6(spark, sf_dir):
    return serve.layer_totals(_window_rows(spark, sf_dir))


@register("api7_f1_per_service", sql(P.WINDOWS, f"""
    SELECT service_name, {r6(F1, 'f1')} FROM (SELECT service_name, {_counts()} FROM windows GROUP BY 1)"""))
def api7(spark, sf_dir):
    return out(serve.f1_per_service(_window_rows(spark, sf_dir)))


_AS_OF = adapter.BASE_US + 140 * 60_000_000


@register("api8_failures_per_minute", sql(P.WINDOWS, f"""
    SELECT strftime(make_timestamp(ts_us - ts_us % 60000000), '%H:%M') AS time, count(*) FILTER ({PRED}) AS failures
    FROM windows WHERE ts_us >= {_AS_OF - 5 * 60_000_000} GROUP BY 1"""))
def api8(spark, sf_dir):
    return serve.failures_per_minute(_window_rows(spark, sf_dir), F.lit(_AS_OF))


_FEED = [c for c in FEED_COLUMNS if c != "timestamp"]
_FEED_DOUBLES = [c for c in _FEED if c in FEATURE_COLUMNS and c != "gc_spike_count" or c in METRICS]


def _ids(spark, sf_dir):
    return adapter.stages(spark, sf_dir).windows


@register("api9_feed", sql(P.WINDOWS, "SELECT " + ", ".join(
    r6(c, c) if c in _FEED_DOUBLES else "hybrid_label AS label" if c == "label" else c for c in _FEED)
    + " FROM windows WHERE window_id > 100"))
def api9(spark, sf_dir):
    return out(serve.feed(_ids(spark, sf_dir), 100), *_FEED)


@register("api9_feed_cursor", sql(P.WINDOWS, """
    SELECT max(window_id) AS last_window_id, count(*) AS new_windows_count FROM windows WHERE window_id > 100"""))
def api9_cursor(spark, sf_dir):
    return serve.feed_cursor(_ids(spark, sf_dir), 100)


_ML = [c for c in ML_COLUMNS if c != "timestamp"]
_ML_DOUBLES = {*FEATURE_COLUMNS, *TREND_COLUMNS, *METRICS, "ram_std_trend"} - {"gc_spike_count"}
_ML_SQL = {
    "project_id": "project_id",
    "label": "hybrid_label AS label",
    "failure_type": "CASE WHEN hybrid_label = 'FAILURE' THEN failure_type ELSE '' END AS failure_type",
    "incident_phase_1": "0 AS incident_phase_1",
    "incident_phase_2": "0 AS incident_phase_2",
}
ML = P.TRENDS + """,
    projects AS (SELECT stack, 'project_' || row_number() OVER (ORDER BY min(window_id)) AS project_id FROM windows GROUP BY 1),
    ml AS (SELECT """ + ", ".join(
    r6(c, c) if c in _ML_DOUBLES else _ML_SQL.get(c, c) for c in _ML
) + " FROM trends JOIN projects USING (stack))"


def _ml(spark, sf_dir):
    return adapter.stages(spark, sf_dir).ml


@register("api10_latest_ml_rows", sql(ML, "SELECT * FROM ml ORDER BY window_id DESC LIMIT 50"))
def api10(spark, sf_dir):
    return out(serve.latest_ml_rows(_ml(spark, sf_dir)), *_ML)


@register("api11_ml_rows_since", sql(ML, "SELECT * FROM ml WHERE window_id > 500"))
def api11(spark, sf_dir):
    return out(serve.windows_since(_ml(spark, sf_dir), 500), *_ML)


@register("api12_alerts", sql(P.CLASSIFIED, f"""
    SELECT 'failure_alert' AS type, service_name, failure_type, hybrid_label, {r6('ram_percent', 'ram_percent')} FROM (
      SELECT * FROM classified QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY ts_us DESC, seq DESC) = 1)
    WHERE {PRED}"""))
def api12(spark, sf_dir):
    latest = serve.latest_per_service(adapter.stages(spark, sf_dir).classified)
    return out(serve.alerts(latest), "type", "service_name", "failure_type", "hybrid_label", "ram_percent")


@register("api13_service_board", sql(P.CLEANED, f"""
    SELECT service_name, {r6s(METRICS)}, gc_count, log_level, ram_percent > 70 AS ram_high FROM cleaned
    QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY ts_us DESC, seq DESC) = 1"""))
def api13(spark, sf_dir):
    return out(serve.service_board(adapter.stages(spark, sf_dir).cleaned))


@register("api13_progress", sql(P.WINDOWS, f"""
    SELECT (SELECT count(*) FROM classified) AS total_rows,
           (SELECT count(DISTINCT service_name) FROM classified) AS active_services,
           (SELECT {r6('avg(ram_percent) FILTER (ram_percent > 0)', 'a')} FROM classified) AS avg_ram,
           count(*) FILTER (hybrid_label = 'FAILURE') AS failure_windows,
           count(*) FILTER (hybrid_label = 'NORMAL') AS normal_windows FROM windows"""))
def api13_progress(spark, sf_dir):
    run = adapter.stages(spark, sf_dir)
    return out(serve.progress(run.classified, windows.sliding_windows(run.classified)))


# ----------------------------------------------------------------------------- sinks

_AUDIT = [c for c in AUDIT_COLUMNS if c != "timestamp"]
_AUDIT_DOUBLES = {*FEATURE_COLUMNS, *METRICS} - {"gc_spike_count"}


@register("snk1_audit_table", sql(P.WINDOWS, "SELECT epoch_us(make_timestamp(ts_us)) AS ts_us, " + ", ".join(
    r6(c, c) if c in _AUDIT_DOUBLES else c for c in _AUDIT) + " FROM windows"))
def snk1(spark, sf_dir):
    """The written files, read back."""
    path = new_path(spark, "audit")
    tables.write_audit(_ids(spark, sf_dir), path)
    audit = spark.read.parquet(path).withColumn("ts_us", F.unix_micros("timestamp"))
    return out(audit, "ts_us", *_AUDIT)


@register("snk2_ml_table", sql(ML, "SELECT * FROM ml"))
def snk2(spark, sf_dir):
    return out(_ml(spark, sf_dir), *_ML)


_ISO = """CASE WHEN ts_us % 1000000 = 0 THEN strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S')
    ELSE strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') END"""
_CELL = lambda c: f"""'"{c}":' || coalesce(to_json({c})::VARCHAR, 'null')"""


@register("snk6_json_records", sql(P.RAW + f""",
    told AS (SELECT * REPLACE (round(ram_percent * 8) / 8 AS ram_percent, round(heap_mb_used * 8) / 8 AS heap_mb_used),
             {_ISO} AS timestamp, 'none' AS failure_type FROM raw)""",
    "SELECT '{' || " + " || ',' || ".join(_CELL(c) for c in SAMPLE_COLUMNS)
    + " || ',\"missing\":null}' AS record FROM told"))
def snk6(spark, sf_dir):
    """All columns; memory in eighths, since the engines print long fractions differently."""
    eighths = {c: F.floor(F.col(c) * 8 + 0.5) / 8 for c in ("ram_percent", "heap_mb_used")}
    rows = adapter.samples(spark, sf_dir).withColumns(eighths | {"missing": F.lit(float("nan"))})
    return serve.to_records(rows.select(*SAMPLE_COLUMNS, "missing"))
