"""The live job: samples arrive, windows leave, every 30 seconds.

Each micro-batch runs the batch operators on the rows the watermark has passed, together
with the few older rows they look back to. What has to be remembered is kept as tables
in a state folder, one version per micro-batch that had rows to process:

* ``fill``: last known metrics per service;
* ``context``: labelled rows inside the look-back, at least ten per service;
* ``window_context``: window rows inside the trend look-back, at least three per service;
* ``catalogue``, ``similarity``: the template model and the scores of its templates;
* ``projects``: project id per stack; ``vocabulary``: the term model, written once.

``pending`` (rows the watermark has not passed yet, so late rows are sorted in) and ``meta``
(watermark, last ids, the version that holds the tables) are written by every micro-batch. The
last ``VERSIONS`` versions are kept, so the folder does not grow with the number of batches.

State is partitioned by the operators like any table, so one busy service is
spread over tasks here too. A repeated micro-batch reads the same earlier version and the raw
rows it stored before, and appends no row twice. Rows behind the watermark go to a ``late``
table. A state folder belongs to one checkpoint; another one is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from failwatch.operators import classify, history, preprocess, templates, trends, windows
from failwatch.schemas import METRICS, SAMPLE_COLUMNS, with_missing
from failwatch.settings import DEFAULTS, MICROS, MINUTE_US, Settings
from failwatch.sinks import tables
from failwatch.sources.samples import with_order
from failwatch.storage import delete, exists, materialize, names_in, scratch

TREND_LOOK_BACK_US = 11 * MINUTE_US
TREND_ROWS = 3
#: Micro-batches whose state is kept: the last one, the one it read, and one to repeat it from.
VERSIONS = 3
_ALL_TIME = (1 << 62)
_TABLES = ("fill", "context", "window_context", "catalogue", "similarity", "projects")
_META = "watermark bigint, last_window_id bigint, last_seq bigint, state bigint"

_CONTEXT = list(dict.fromkeys([*windows.PASSED_THROUGH, "log_message"]))
_TEMPLATED = [c for c in _CONTEXT if c not in ("hybrid_label", "detection_layer", "failure_type")]
_WINDOW_CONTEXT = ["service_name", "ts_us", "seq", "hybrid_label", "ram_std"]
_CATALOGUE = ["leaf", "cluster", "template_id", "template", "first_seq", "n"]


class LiveJob:
    """Incremental run over micro-batches; use ``start`` or feed ``process`` directly."""

    def __init__(
        self,
        spark: SparkSession,
        out_dir: str,
        state_dir: str,
        settings: Settings = DEFAULTS,
        delay_seconds: float = 120.0,
        vocabulary: DataFrame | None = None,
    ):
        self.spark = spark
        self.out_dir = out_dir
        self.state_dir = state_dir
        self.settings = settings
        self.delay_us = int(delay_seconds * MICROS)
        self.vocabulary = vocabulary

    # ------------------------------------------------------------------ stream

    def start(self, samples: DataFrame, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
        """Run on a streaming DataFrame; ``every=None`` takes what is there and stops."""
        known = self._read("checkpoint", None)
        if known is None:
            self.spark.createDataFrame([(checkpoint,)], "path string").write.parquet(self._path("checkpoint", None))
        elif known.first()["path"] != checkpoint:
            raise ValueError(f"{self.state_dir} belongs to the checkpoint {known.first()['path']}")
        writer = samples.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return writer.trigger(**trigger).start()

    def process(self, arrivals: DataFrame, batch_id: int) -> None:
        with scratch(self.spark):
            self._advance(arrivals, batch_id)

    def finish(self) -> None:
        """Let the watermark pass everything, at the end of a bounded run."""
        done = self._versions("meta")
        if done:
            with scratch(self.spark):
                self._advance(None, done[-1] + 1)

    # ------------------------------------------------------------------- state

    def _path(self, name: str, batch: int | None) -> str:
        return f"{self.state_dir}/{name}" + ("" if batch is None else f"/batch={batch}")

    def _versions(self, name: str) -> list[int]:
        """Micro-batches that have a complete version of a table."""
        found = [int(n.removeprefix("batch=")) for n in names_in(self.spark, self._path(name, None))]
        return sorted(v for v in found if exists(self.spark, f"{self._path(name, v)}/_SUCCESS"))

    def _read(self, name: str, batch: int | None) -> DataFrame | None:
        path = self._path(name, batch)
        return self.spark.read.parquet(path) if exists(self.spark, f"{path}/_SUCCESS") else None

    def _state(self, name: str, version: int | None) -> DataFrame | None:
        return None if version is None else self._read(name, version)

    def _write(self, name: str, batch: int | None, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(name, batch))

    def _before(self, batch: int) -> Row | None:
        """What the micro-batch before this one left; none for the first."""
        done = self._versions("meta")
        if (batch - 1 not in done and (done or batch > 0)) and not (batch == 0 and done == [0]):
            raise ValueError(f"{self.state_dir} holds micro-batches {done}, which do not lead to {batch}")
        meta = self._read("meta", batch - 1)
        return meta.first() if meta is not None else None

    def _run_id(self) -> str:
        """Name of the run the state folder belongs to; keeps its raw rows apart from others'."""
        if self._read("run", None) is None:
            self._write("run", None, self.spark.createDataFrame([(uuid.uuid4().hex,)], "id string"))
        return self._read("run", None).first()["id"]

    def _store(self, arrivals: DataFrame, batch: int, last_seq: int) -> DataFrame:
        """The arrivals as stored raw rows; a repeated micro-batch finds them stored."""
        path = f"{self.out_dir}/raw/run={self._run_id()}/batch={batch}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            ordered = arrivals if "seq" in arrivals.columns else _number_arrivals(arrivals, last_seq)
            rows = with_order(with_missing(ordered, SAMPLE_COLUMNS)).select(*SAMPLE_COLUMNS, "ts_us", "seq")
            rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _advance(self, arrivals: DataFrame | None, batch: int) -> None:
        """Take in one micro-batch; None passes everything that is pending."""
        meta = self._before(batch)
        watermark, last_id, last_seq, state = meta or (-_ALL_TIME, 0, -1, None)
        pending = self._read("pending", batch - 1)
        passed = _ALL_TIME
        if arrivals is not None:
            stored = self._store(arrivals, batch, last_seq)
            behind = F.coalesce(F.col("ts_us") < watermark, F.lit(True))
            late = f"{self.out_dir}/late/run={self._run_id()}/batch={batch}"
            stored.where(behind).write.mode("overwrite").parquet(late)
            on_time = stored.where(~behind)
            pending = on_time if pending is None else pending.unionByName(on_time)
            newest = pending.agg(F.max("ts_us")).first()[0]
            passed = watermark if newest is None else max(watermark, newest - self.delay_us)
            last_seq = max(last_seq, stored.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0])
        ready = pending.where(F.col("ts_us") < passed)
        if not ready.isEmpty():
            last_id = self._run(ready, watermark, passed, state, batch, last_id)
            state = batch
        self._write("pending", batch, pending.where(F.col("ts_us") >= passed))
        # Written last: its presence says that the version is complete.
        self._write("meta", batch, self.spark.createDataFrame([(passed, last_id, last_seq, state)], _META).coalesce(1))
        self._forget(batch)

    def _forget(self, batch: int) -> None:
        """Remove the versions that no kept micro-batch refers to."""
        kept = [v for v in self._versions("meta") if v > batch - VERSIONS]
        used = {self._read("meta", v).first()["state"] for v in kept}
        for name in ("meta", "pending", *_TABLES):
            wanted = used if name in _TABLES else kept
            for v in self._versions(name):
                if v <= batch - VERSIONS and v not in wanted:
                    delete(self.spark, self._path(name, v))

    # --------------------------------------------------------------- one batch

    def _run(
        self, ready: DataFrame, watermark: int, passed: int, before: int | None, batch: int, last_id: int
    ) -> int:
        s = self.settings
        cleaned = self._clean(ready, watermark, before, batch)
        templated = materialize(self._template(cleaned, before, batch), "templated")
        similarity = self._similarity(templated, before, batch)

        old_rows = self._state("context", before)
        both = _after(old_rows, templated.select(*_TEMPLATED), _TEMPLATED)
        labelled = classify.classify(both, s, similarity).where(~F.col("_old"))
        labelled = materialize(labelled.select(*_CONTEXT), "labelled")
        both = _after(old_rows, labelled, _CONTEXT)
        self._write(
            "context", batch,
            _recent(both, passed - s.window_us, s.gc_history_rows).select(*_CONTEXT),
        )

        made = windows.sliding_windows(both, s, keep=["_old"]).where(~F.col("_old")).drop("_old")
        made = materialize(made, "windows")
        old_windows = self._state("window_context", before)
        both_windows = _after(old_windows, made, made.columns)
        self._write(
            "window_context", batch,
            _recent(both_windows, passed - TREND_LOOK_BACK_US, TREND_ROWS).select(*_WINDOW_CONTEXT),
        )
        lagged = trends.add_ram_std_trend(both_windows, settings=s)
        trended = trends.add_failure_trends(lagged).where(~F.col("_old")).drop("_old")
        numbered = materialize(
            windows.number_windows(trended, labelled, s, last_id + 1, counted=made), "numbered"
        )
        projects = self._projects(numbered, before, batch)
        tables.save_windows(numbered, f"{self.out_dir}/audit", f"{self.out_dir}/ml_ready", projects)
        return numbered.agg(F.coalesce(F.max("window_id"), F.lit(last_id))).first()[0]

    def _clean(self, ready: DataFrame, watermark: int, before: int | None, batch: int) -> DataFrame:
        """Preprocess; the last known metrics stand in as one row per service."""
        unique = preprocess.drop_duplicates(ready)
        known = self._state("fill", before)
        if known is not None:
            known = with_missing(
                known.withColumns(
                    {"ts_us": F.lit(watermark - 1), "seq": F.lit(-1).cast("bigint")}
                ),
                SAMPLE_COLUMNS,
            )
        both = materialize(_after(known, unique, unique.columns), "unfilled")
        filled = materialize(preprocess.fill_metrics(both, self.settings), "filled")
        # Rows are filled, so the newest one of a service has all that is known; limited before the shuffle.
        newest = Window.partitionBy(history.KEY).orderBy(F.col("ts_us").desc_nulls_first(), F.col("seq").desc())
        latest = (
            filled.where(F.col("service_name").isNotNull())
            .select(history.KEY, "ts_us", "seq", *METRICS)
            .withColumn("_rn", F.row_number().over(newest))
            .where("_rn = 1")
            .select(history.KEY, *METRICS)
        )
        self._write("fill", batch, latest)
        fresh = filled.where(~F.col("_old")).drop("_old")
        return (
            fresh.transform(preprocess.drop_blank_messages)
            .transform(preprocess.clip_metrics)
            .transform(preprocess.clean_messages)
        )

    def _template(self, cleaned: DataFrame, before: int | None, batch: int) -> DataFrame:
        known = self._state("catalogue", before)
        mined = materialize(templates.mine_templates(cleaned, self.settings, catalogue=known), "mined")
        updated = templates.template_catalogue(mined).select(*_CATALOGUE, F.lit(1).alias("age"))
        if known is not None:
            updated = (
                known.select(*_CATALOGUE, F.lit(0).alias("age")).unionByName(updated)
                .groupBy("leaf", "cluster", "template_id")
                .agg(
                    F.max_by("template", "age").alias("template"),
                    F.min_by("first_seq", "age").alias("first_seq"),
                    F.sum("n").alias("n"),
                )
            )
        self._write("catalogue", batch, updated.select(*_CATALOGUE))
        return mined

    def _similarity(self, templated: DataFrame, before: int | None, batch: int) -> DataFrame:
        """Similarity of every template so far; the term model is fitted once and kept."""
        found = classify.distinct_templates(templated)
        if self._read("vocabulary", None) is None:
            vocabulary = self.vocabulary
            if vocabulary is None:
                found = materialize(found, "distinct-templates")
                vocabulary = classify.fit_terms(found, settings=self.settings).vocabulary
            self._write("vocabulary", None, vocabulary)
        vocabulary = self._read("vocabulary", None)
        known = self._state("similarity", before)
        fresh = found if known is None else found.join(known, "log_template", "left_anti")
        scored = classify.frozen_similarity(materialize(fresh, "fresh-templates"), vocabulary)
        self._write("similarity", batch, scored if known is None else known.unionByName(scored))
        return self._read("similarity", batch)

    def _projects(self, numbered: DataFrame, before: int | None, batch: int) -> DataFrame:
        known = self._state("projects", before)
        firsts = numbered.groupBy("stack").agg(F.min("window_id").alias("_first"))
        start = 0
        if known is not None:
            # Null-safe: rows without a stack get one id for ever, as in the batch.
            firsts = firsts.join(known, firsts["stack"].eqNullSafe(known["stack"]), "left_anti")
            start = known.count()
        # One row per stack.
        rank = F.row_number().over(Window.orderBy("_first")) + F.lit(start)
        ids = firsts.select("stack", F.concat(F.lit("project_"), rank).alias("project_id"))
        self._write("projects", batch, ids if known is None else known.unionByName(ids))
        return self._read("projects", batch)


def _number_arrivals(df: DataFrame, last_seq: int) -> DataFrame:
    """Number the arrivals on from ``last_seq`` without gaps: by partition, then row."""
    placed = materialize(df.withColumn("_at", F.monotonically_increasing_id()), "arrivals")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # One row per partition.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(starts, "_part").withColumn("seq", F.lit(last_seq + 1) + F.col("_start") + row)
    return numbered.drop("_at", "_part", "_start")


def _after(old: DataFrame | None, new: DataFrame, columns: list[str]) -> DataFrame:
    """Older rows, marked, followed by the new ones."""
    marked = new.withColumn("_old", F.lit(False))
    if old is None:
        return marked
    kept = old.select(*[c for c in old.columns if c in columns]).withColumn("_old", F.lit(True))
    return marked.unionByName(kept, allowMissingColumns=True)


def _recent(df: DataFrame, since_us: int, rows: int) -> DataFrame:
    """Rows since a time plus as many older ones that each service keeps ``rows`` in all.

    The row limit is applied before the shuffle, so a busy service is not gathered.
    """
    newest = Window.partitionBy(history.KEY).orderBy(F.col("ts_us").desc(), F.col("seq").desc())
    last = df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= rows)
    older = last.where(F.col("ts_us") < since_us).drop("_rn")
    return df.where(F.col("ts_us") >= since_us).unionByName(older)
