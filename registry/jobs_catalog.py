"""Registered queries that write tables, run streams or train models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from failwatch.operators import enrich, importance, templates
from failwatch.plans import jobs
from failwatch.functions.timeaxis import from_micros
from failwatch.schemas import FEATURE_COLUMNS, MODEL_COLUMNS, SAMPLES, SAMPLE_COLUMNS, TREND_COLUMNS
from failwatch.sinks import tables
from failwatch.sources import samples as sources
from failwatch.storage import materialize, names_in, new_path
from failwatch.streaming import blocks, containers, operators as streams
from failwatch.streaming.live import LiveJob
from registry import adapter, oracle_parts as P
from registry.catalog import ENTRIES, KEY_LIST, KEYS, METRICS, ML, _ML, out, r6, r6s, register, sql

FEATURES = [*FEATURE_COLUMNS]
FEATURE_LIST = ", ".join(c if c == "gc_spike_count" else r6(c, c) for c in FEATURES)
FILES = 4
_STREAM_SCHEMA = T.StructType([*SAMPLES, T.StructField("seq", T.LongType())])


def _mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.mine_templates(adapter.stages(spark, sf_dir).cleaned)


@register("tpl1_template_mining", None)
def tpl1(spark, sf_dir):
    return _mined(spark, sf_dir).select(*KEYS, "log_template", "template_id")


@register("tpl1_template_mining_final", None)
def tpl1_final(spark, sf_dir):
    cleaned = adapter.stages(spark, sf_dir).cleaned
    return templates.mine_templates(cleaned, final=True).select(*KEYS, "log_template", "template_id")


@register("tpl1_template_mining_conversations", None)
def tpl1_conversations(spark, sf_dir):
    """Mining free text: every turn of the conversations is a message."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat(F.lit("conv-"), "conv_id").alias("service_name"),
        F.col("turn").alias("ts_us"),
        F.col("conv_id").alias("seq"),
        F.coalesce("text", F.lit("")).alias("log_message"),
    )
    return templates.mine_templates(turns).select(*KEYS, "log_template", "template_id")


@register("tpl2_template_catalogue", None)
def tpl2(spark, sf_dir):
    return templates.template_catalogue(_mined(spark, sf_dir))


_LEAVES = r"""
    SELECT n_tokens, first_token, count(*) AS rows, 0::BIGINT AS not_fitting FROM (
        SELECT len(t)::BIGINT AS n_tokens, CASE WHEN regexp_matches(t[1], '\d') THEN '<*>' ELSE t[1] END AS first_token
        FROM (SELECT regexp_split_to_array(log_message, '\s+') AS t FROM cleaned WHERE log_message <> ''))
    GROUP BY ALL"""


@register("tpl1_rows_per_leaf", sql(P.CLEANED, _LEAVES))
def tpl1_leaves(spark, sf_dir):
    """Mined rows by token count and first token of their final template, and how many do not fit it."""
    mined = templates.mine_templates(adapter.stages(spark, sf_dir).cleaned, final=True).where("log_message <> ''")
    pair = F.arrays_zip(F.split("log_template", " ").alias("t"), F.split("log_message", r"\s+").alias("m"))
    fits = F.forall(pair, lambda x: (x["t"] == "<*>") | x["t"].eqNullSafe(x["m"]))
    first = F.split("log_template", " ")[0]
    told = mined.select(F.size(F.split("log_template", " ")).alias("n_tokens"), first.alias("first_token"), fits.alias("fits"))
    return out(told.groupBy("n_tokens", "first_token").agg(
        F.count("*").alias("rows"), F.count_if(~F.col("fits")).alias("not_fitting")))


@register("src13_ml_table_read_back", sql(ML, "SELECT * FROM ml"))
def src13(spark, sf_dir):
    path = new_path(spark, "ml")
    adapter.stages(spark, sf_dir).write_ml(path)
    return out(sources.read_ml_table(spark, path), *_ML)


@register("snk3_raw_samples", sql(P.RAW, f"""
    SELECT service_name, stack, log_level, {r6s(METRICS)}, gc_count, ground_truth_label, failure_type
    FROM (SELECT *, 'none' AS failure_type FROM raw)"""))
def snk3(spark, sf_dir):
    path = new_path(spark, "raw")
    tables.write_samples(adapter.samples(spark, sf_dir), path)
    return out(sources.read_csv(spark, path), "service_name", "stack", "log_level", *METRICS, "gc_count",
               "ground_truth_label", "failure_type")


def _sample_files(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    return _arriving(adapter.samples(spark, sf_dir).select(*_STREAM_SCHEMA.fieldNames(), "ts_us"), ["ts_us"])


#: Rows of an arrival that one task writes as a file of its own.
ARRIVAL_ROWS = 250_000


def _arriving(rows: DataFrame, helpers: list[str] = ()) -> tuple[str, int]:
    """The rows as arrivals for a stream to pick up, written one after the other: rows
    of one stretch of time each, some of them up to a minute late.

    Gives the folder and the number of files per arrival, which grows with the rows, so that no
    task writes or reads a whole arrival. Every arrival has that number, empty ones included."""
    spark = rows.sparkSession
    path = new_path(spark, "arrivals")
    first, last, n = rows.agg(F.min("ts_us"), F.max("ts_us"), F.count("*")).first()
    delay = F.pmod(F.col("seq") * 7_368_787, F.lit(60_000_000))
    part = F.least(
        F.call_function("div", (F.col("ts_us") + delay - first) * FILES, F.lit(last - first + 1)), F.lit(FILES - 1)
    )
    files = max(1, -(-n // (FILES * ARRIVAL_ROWS)))
    for i in range(FILES):
        arrival = rows.where(part == i).drop(*helpers)
        dealt = arrival.coalesce(1) if files == 1 else arrival.repartition(files)
        dealt.write.mode("append").parquet(path)
        # A task without rows writes no file, and a stream counts files.
        for _ in range(files * (i + 1) - len([f for f in names_in(spark, path) if f.startswith("part-")])):
            arrival.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path, files


#: The samples with the number of the file they arrive in.
ARRIVED = P.RAW + f""", arrived AS (
    SELECT *, least((ts_us + seq * 7368787 % 60000000 - (SELECT min(ts_us) FROM raw)) * {FILES}
                    // (SELECT max(ts_us) - min(ts_us) + 1 FROM raw), {FILES - 1})::BIGINT AS part FROM raw)"""


def _arrivals(spark: SparkSession, sf_dir: str, per_batch: int | None = None) -> DataFrame:
    """The samples as a stream, ``per_batch`` arrivals a micro-batch."""
    path, files = _sample_files(spark, sf_dir)
    return streams.read_samples_stream(spark, path, _STREAM_SCHEMA, files_per_batch=per_batch and per_batch * files)


def _collected(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read its result table; updates carry their ``batch``."""
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, "stream"), new_path(spark, "checkpoint")
    if mode == "append":
        writer = streams.append_samples(stream, path, checkpoint)
    else:
        writer = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}"))
        )
    writer.trigger(availableNow=True).start().awaitTermination()
    result = spark.read.parquet(path)
    return result if mode == "append" else result.withColumn("batch", F.col("batch").cast("bigint"))


@register("snk4_stream_append", sql(P.RAW, "SELECT service_name, count(*) AS rows, sum(gc_count)::BIGINT AS gc FROM raw GROUP BY 1"))
def snk4(spark, sf_dir):
    """Also the continuous source (SRC12): files read as a stream, appended exactly once."""
    appended = _collected(_arrivals(spark, sf_dir), "append")
    return appended.groupBy("service_name").agg(F.count("*").alias("rows"), F.sum("gc_count").alias("gc"))


@register("snk5_append_new_windows", sql(P.WINDOWS, f"SELECT {KEY_LIST}, window_id, {FEATURE_LIST} FROM windows"))
def snk5(spark, sf_dir):
    """Half of the windows, then all of them: only the missing half is added."""
    run = adapter.stages(spark, sf_dir)
    projects = materialize(enrich.project_ids(run.trended, "stack"), "projects")
    audit, ml = new_path(spark, "audit"), new_path(spark, "ml")
    tables.save_windows(run.trended.where("seq % 2 = 0"), audit, ml, projects)
    tables.save_windows(run.trended, audit, ml, projects)
    return out(spark.read.parquet(audit), *KEYS, "window_id", *FEATURES)


@register("str1_stream_dedupe", sql(P.DEDUPED, "SELECT service_name, ts_us, log_message FROM deduped"))
def str1(spark, sf_dir):
    unique = _collected(streams.drop_duplicates_stream(_arrivals(spark, sf_dir), "10 minutes"), "append")
    return unique.select("service_name", F.unix_micros("timestamp").alias("ts_us"), "log_message")


@register("str4_stream_failures_per_minute", sql(P.RAW, """
    SELECT service_name, ts_us - ts_us % 60000000 AS minute_us,
           count(*) FILTER (ground_truth_label = 'FAILURE') AS failures FROM raw GROUP BY 1, 2
    HAVING minute_us + 60000000 <= (SELECT max(ts_us) FROM raw) - 120000000"""))
def str4(spark, sf_dir):
    """Append mode: minutes come out, final, once the watermark has passed them."""
    labelled = _arrivals(spark, sf_dir, 1).withColumn("hybrid_label", F.col("ground_truth_label"))
    counted = _collected(streams.failures_per_minute_stream(labelled), "append")
    return counted.select("service_name", F.unix_micros("minute").alias("minute_us"), "failures")


_NEWEST = ARRIVED + f""", batches AS (SELECT DISTINCT service_name, part AS batch FROM arrived),
    newest AS (
    SELECT a.*, batch FROM batches JOIN arrived a USING (service_name) WHERE part <= batch
    QUALIFY row_number() OVER (PARTITION BY service_name, batch ORDER BY ts_us DESC, seq DESC) = 1)"""


def _labelled_arrivals(spark, sf_dir):
    return _arrivals(spark, sf_dir, 1).withColumns(
        {"hybrid_label": F.col("ground_truth_label"), "ts_us": F.unix_micros("timestamp")}
    )


@register("str5_stream_latest_per_service", sql(_NEWEST, f"""
    SELECT batch, service_name, ts_us, stack, log_level, log_message, {r6s(METRICS)}, gc_count,
           ground_truth_label AS hybrid_label FROM newest"""))
def str5(spark, sf_dir):
    """Update mode: after each micro-batch the latest row of the services that had one in it."""
    latest = _collected(streams.latest_per_service_stream(_labelled_arrivals(spark, sf_dir)), "update")
    return out(latest, "batch", "service_name", "ts_us", "stack", "log_level", "log_message", *METRICS, "gc_count", "hybrid_label")


@register("api12_stream_alerts", sql(_NEWEST, f"""
    SELECT batch, 'failure_alert' AS type, service_name, 'none' AS failure_type, ground_truth_label AS hybrid_label,
           {r6('ram_percent', 'ram_percent')}, ts_us FROM newest WHERE ground_truth_label = 'FAILURE'"""))
def api12_stream(spark, sf_dir):
    """Update mode: an alert per micro-batch in which the latest row of a service is a failure."""
    alerts = _collected(streams.alerts_stream(_labelled_arrivals(spark, sf_dir)), "update")
    return out(alerts.withColumn("ts_us", F.unix_micros("timestamp")), "batch", "type", "service_name", "failure_type",
               "hybrid_label", "ram_percent", "ts_us")


#: Blocks that the watermark, two minutes behind the newest row, has passed at the end.
def _closed(rows: str) -> str:
    return f"ts_us - ts_us % 300000000 + 300000000 <= (SELECT max(ts_us) FROM {rows}) - 120000000"


@register("str3_stream_frames_and_trends", sql(P.TRENDS, f"""
    SELECT {KEY_LIST}, stack, log_template, {r6('ram_percent', 'ram_percent')}, gc_count, hybrid_label, window_label, window_rows,
           {FEATURE_LIST}, {r6('window_duration_seconds', 'window_duration_seconds')}, {r6s(TREND_COLUMNS)}
    FROM trends WHERE {_closed('scored')}"""))
def str3(spark, sf_dir):
    """Frame features, labels and trends of a labelled stream in the engine's state, one file at a time."""
    labelled = adapter.stages(spark, sf_dir).classified.withColumn("timestamp", from_micros(F.col("ts_us")))
    path, files = _arriving(labelled)
    arrivals = streams.read_samples_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=files)
    found = _collected(blocks.frames_stream(arrivals), "append")
    return out(found, *KEYS, "stack", "log_template", "ram_percent", "gc_count", "hybrid_label", "window_label", "window_rows",
               *FEATURES, "window_duration_seconds", *TREND_COLUMNS)


@register("str7_stream_windows_to_tables", sql(P.TRENDS, f"""
    SELECT {KEY_LIST}, {FEATURE_LIST}, {r6s(TREND_COLUMNS)}, hybrid_label, 'project_' || stack AS project_id
    FROM trends WHERE {_closed('scored')}"""))
def str7(spark, sf_dir):
    """The same stream into the audit and the ML table, a partition per micro-batch; both read back and joined."""
    labelled = adapter.stages(spark, sf_dir).classified.withColumn("timestamp", from_micros(F.col("ts_us")))
    path, files = _arriving(labelled)
    arrivals = streams.read_samples_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=2 * files)
    projects = materialize(labelled.select("stack", F.concat(F.lit("project_"), "stack").alias("project_id")).distinct(), "projects")
    audit, ml = new_path(spark, "audit"), new_path(spark, "ml")
    writer = blocks.windows_to_tables(arrivals, audit, ml, projects, new_path(spark, "checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    trends = spark.read.parquet(ml).select("ts_us", "seq", "window_id", "project_id", *TREND_COLUMNS)
    both = spark.read.parquet(audit).join(trends, ["ts_us", "seq", "window_id"])
    return out(both, *KEYS, *FEATURES, *TREND_COLUMNS, "hybrid_label", "project_id")


_STREAM_FILLED = P.RAW + P.FILLED.removeprefix(P.DEDUPED).replace("FROM deduped", "FROM raw") + """, told AS (
    SELECT *, sum(CASE WHEN log_message LIKE 'INFO signup%' THEN 1 ELSE 0 END) OVER (
        PARTITION BY service_name ORDER BY ts_us, seq)::BIGINT AS gc_seen, trim(log_message) = '' AS blank FROM filled),
  shown AS (
    SELECT service_name, seq, gc_count - coalesce(lag(gc_count, 9) OVER s, first_value(gc_count) OVER s) AS gc_jump
    FROM told WHERE NOT blank WINDOW s AS (PARTITION BY service_name ORDER BY ts_us, seq))"""


@register("str2_stream_fill_and_counters", sql(_STREAM_FILLED, f"""
    SELECT {KEY_LIST}, {r6s(METRICS)}, gc_count::DOUBLE AS gc_count, gc_seen, blank, gc_jump::DOUBLE AS gc_jump
    FROM told LEFT JOIN shown USING (service_name, seq) WHERE {_closed('raw')}"""))
def str2(spark, sf_dir):
    """Forward fill, the counter of collections (SRC9) and the ten-row jump (CLS6), handed on from block to block."""
    arrivals = _arrivals(spark, sf_dir, 1).withColumns(
        {"ts_us": F.unix_micros("timestamp"), "log_message": F.regexp_replace("log_message", "^INFO signup", "INFO gc pause")}
    )
    closed = _collected(blocks.blocks_stream(arrivals), "append")
    summaries = spark.readStream.schema(closed.schema).parquet(closed.inputFiles()[0].rsplit("/", 1)[0])
    carries = _collected(blocks.carries_stream(summaries), "append")
    names = [*KEYS, *METRICS, "gc_count"]
    columns = T.StructType([arrivals.schema[c] if c not in (*METRICS, "gc_count") else T.StructField(c, T.DoubleType()) for c in names])
    return out(blocks.filled_rows(closed, carries, columns), *names, "gc_seen", "blank", "gc_jump")


def _json_arrivals(rows: DataFrame) -> DataFrame:
    """The rows as a stream of JSON files, one file a micro-batch."""
    path = new_path(rows.sparkSession, "records")
    first, last = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    part = F.least(F.call_function("div", (F.col("ts_us") - first) * FILES, F.lit(last - first + 1)), F.lit(FILES - 1))
    for i in range(FILES):
        rows.where(part == i).coalesce(1).write.mode("append").json(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(path)


_STREAMED = ("ts_us - ts_us % 300000000 + 300000000 <= (SELECT max(greatest(c.tick, l.tick)) FROM ticked c, last_lines l) - 120000000")


@register("src12_stream_container_samples", ENTRIES["src10_container_samples"].sql.replace(
    "SELECT c.name AS service_name", "SELECT * FROM (SELECT c.name AS service_name") + f""") WHERE {_STREAMED}""")
def src12(spark, sf_dir):
    """Container records and log lines, each a stream of JSON files, to samples with a running counter."""
    minute = F.col("ts_us") - F.pmod("ts_us", F.lit(60_000_000))
    records = _json_arrivals(adapter.container_stats(spark, sf_dir).withColumn("ts_us", minute))
    lines = _json_arrivals(adapter.log_lines(spark, sf_dir))
    closed = _collected(containers.container_blocks_stream(records, lines), "append")
    summaries = spark.readStream.schema(closed.schema).parquet(closed.inputFiles()[0].rsplit("/", 1)[0])
    carries = _collected(blocks.carries_stream(summaries), "append")
    return out(containers.container_rows(closed, carries), *KEYS, "stack", "log_message", "log_level", *METRICS, "gc_count",
               "ground_truth_label", "failure_type")


def _live(spark: SparkSession, sf_dir: str) -> str:
    """Run the live job over the samples in four micro-batches; gives its folder."""
    folder = new_path(spark, "live")
    job = LiveJob(spark, folder, f"{folder}/state")
    path, files = _sample_files(spark, sf_dir)
    source = streams.read_samples_stream(spark, path, _STREAM_SCHEMA, files_per_batch=2 * files)
    job.start(source, f"{folder}/checkpoint", every=None).awaitTermination()
    job.finish()
    return folder


@register("job3_live_windows", sql(P.WINDOWS, f"SELECT {KEY_LIST}, {FEATURE_LIST} FROM windows"))
def job3(spark, sf_dir):
    """STR2, STR3, STR6 and STR7 together: frame features of the live run equal the batch."""
    return out(spark.read.parquet(f"{_live(spark, sf_dir)}/audit"), *KEYS, *FEATURES)


@register("job1_batch_overall_scores", None)
def job1(spark, sf_dir):
    """The whole batch job with mined templates; its overall scores."""
    result = jobs.run_batch(adapter.samples(spark, sf_dir), new_path(spark, "batch"))
    return out(result.reports["overall"])


@register("job1_batch_masked_ml_table", sql(ML, "SELECT * FROM ml"))
def job1_masked(spark, sf_dir):
    """The whole batch job with masked templates, which SQL can compute too: the ML table it wrote."""
    path = new_path(spark, "batch")
    jobs.run_batch(adapter.samples(spark, sf_dir), path, templating=adapter.with_mask_template)
    return out(sources.read_ml_table(spark, f"{path}/ml_ready"), *_ML)


@register("job2_windows_without_export", sql(P.WINDOWS, f"SELECT {KEY_LIST}, window_id, {FEATURE_LIST} FROM windows"))
def job2(spark, sf_dir):
    _, windows = jobs.run_without_export(adapter.samples(spark, sf_dir))
    return out(windows, *KEYS, "window_id", *FEATURES)


@register("evl11_feature_importance", None)
def evl11(spark, sf_dir):
    return importance.feature_importance(adapter.stages(spark, sf_dir).window_rows)


@register("evl11_training_rows", sql(P.WINDOWS, f"""
    SELECT count(*) AS rows, count(*) FILTER (ground_truth_label = 'FAILURE') AS failures,
           count(*) FILTER (ground_truth_label <> 'FAILURE') AS normal FROM windows
    WHERE ground_truth_label IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in MODEL_COLUMNS)}"""))
def evl11_rows(spark, sf_dir):
    return importance.row_counts(importance.training_rows(adapter.stages(spark, sf_dir).window_rows))


@register("evl11_novel_share", None)
def evl11_share(spark, sf_dir):
    return importance.novel_share(importance.feature_importance(adapter.stages(spark, sf_dir).window_rows))
