"""Live samples from container records and log lines.

Both arrive as streams of raw rows and meet in the blocks of ``streaming/blocks``: statistics are
parsed on the way in, the state of a (service, block) keeps accepted records and, of each tick, at
most three lines per micro-batch. When the watermark has passed the block, each record takes the
last lines of its tick. The counter of collections, which looks back without limit, is handed on
from block to block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from failwatch.functions import text
from failwatch.functions.timeaxis import from_micros, slot
from failwatch.operators.history import KEY
from failwatch.schemas import METRICS, SAMPLE_COLUMNS
from failwatch.settings import DEFAULTS, Settings
from failwatch.sources.container import LOG_TAIL, parse_stats, unlabelled
from failwatch.streaming.blocks import BLOCK, CLOSED, BlockProcessor, filled_rows, summed_up, use_state_store

_MEASURED = [c for c in METRICS if c != "gc_count"]
_ROWS = f"{KEY} string, ts_us bigint, seq bigint, stack string, log_message string, {', '.join(f'{c} double' for c in _MEASURED)}"


def _last_lines(rows: pd.DataFrame) -> pd.DataFrame:
    """The records and the last lines of every tick, lines in their order."""
    is_line = rows["line"].notna()
    lines = rows[is_line].sort_values(["ts_us", "seq"], kind="stable").groupby("ts_us", sort=False).tail(LOG_TAIL)
    return pd.concat([rows[~is_line], lines], ignore_index=True)


def container_blocks_stream(
    stats: DataFrame, lines: DataFrame, settings: Settings = DEFAULTS, delay: str = "2 minutes"
) -> DataFrame:
    """Closed blocks of samples from streams of ``stats`` (seq, ts_us, name, image_tag, stats) and
    ``lines`` (ts_us, name, line_no, line); see ``blocks_stream``.

    Records without a required field, without a time or a name are left out, as are null lines."""
    use_state_store(stats)
    back = settings.gc_history_rows - 1
    records = parse_stats(stats).where("stats_ok").select(
        F.col("name").alias(KEY), "ts_us", "seq", text.detect_stack(F.col("image_tag")).alias("stack"), *_MEASURED
    )
    said = lines.where("line is not null").select(
        F.col("name").alias(KEY), "ts_us", F.col("line_no").alias("seq"), "line", text.has_gc_word(F.col("line")).alias("gc_word")
    )
    both = (
        records.unionByName(said, allowMissingColumns=True)
        .where(F.col("ts_us").isNotNull() & F.col(KEY).isNotNull())
        .withColumn("timestamp", from_micros(F.col("ts_us")))
        .withWatermark("timestamp", delay)
        .withColumn(BLOCK, slot(F.col("ts_us"), settings.slice_us))
    )

    def close(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept = _last_lines(rows)
        lines = kept[kept["line"].notna()].groupby("ts_us")
        samples = kept[kept["line"].isna()].drop(columns=["line", "gc_word"])
        if samples.empty:
            return pd.DataFrame(columns=StructType.fromDDL(CLOSED).fieldNames())
        # No word of the three reaches over the mark between two lines.
        told = samples.assign(
            log_message=samples["ts_us"].map(lines["line"].agg(" | ".join)).fillna(""),
            gc_word=samples["ts_us"].map(lines["gc_word"].any()).eq(True),
            gc_count=float("nan"), blank=False,
        )
        return summed_up(key, told.sort_values(["ts_us", "seq"], ignore_index=True), back)

    return both.groupBy(KEY, BLOCK).transformWithStateInPandas(
        BlockProcessor(settings.slice_us, close, _last_lines), CLOSED, outputMode="Append", timeMode="EventTime"
    )


def container_rows(blocks: DataFrame, carries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The samples of closed container blocks, in the columns of a finished sample."""
    rows = filled_rows(blocks, carries, StructType.fromDDL(_ROWS), settings)
    message = F.col("log_message")
    made = {"gc_count": F.col("gc_seen"), "timestamp": from_micros(F.col("ts_us")), "log_level": text.detect_log_level(message), **unlabelled()}
    return rows.withColumns(made).select(*SAMPLE_COLUMNS, "ts_us", "seq")
