"""Look-back operators on a stream, with the engine's own state.

A stream is cut like the batch: rows are keyed by (service, block of time), so a service with a
third of all rows is spread over tasks and over keys. The rows of a block wait in a list state, one
element per micro-batch; an event-time timer at the end of the block fires once the watermark has
passed it, sorts the rows, gives the results and clears the state. Watermark, late rows, expiry and
recovery are the engine's: a row behind the watermark is dropped, a restart goes on from the
checkpoint.

* ``frames_stream``: frame features, labels and failure trends. A row is copied, with the columns
  that frames read, to the following blocks that look back to it, so each block is complete by
  itself.
* ``blocks_stream`` and ``carries_stream``: forward fill, the garbage-collection counter and the
  jump over ten rows look back without limit. The first gives closed blocks with a summary of a few
  numbers; the second, over the summaries alone, keeps a value state per service and hands on to
  each block what all earlier ones add up to. ``filled_rows`` joins the two and works out the
  rows, in parallel over blocks. Each stream has its own checkpoint and appends to its own table.

Rows without a time or a service have no place in time and are left out. Blocks that the watermark
has not passed stay in the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from failwatch.functions import frames, text
from failwatch.functions.timeaxis import from_micros, slot
from failwatch.operators.history import KEY
from failwatch.operators.windows import PASSED_THROUGH
from failwatch.schemas import METRICS, TREND_COLUMNS, WINDOW_COLUMNS
from failwatch.settings import DEFAULTS, MINUTE_US, Settings
from failwatch.sinks import tables

#: What trends look back beyond the frame: ten minutes of failures of the last minute.
TREND_LOOK_BACK_US = 11 * MINUTE_US
BLOCK = "block"
HOME = "home"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_READ = [*METRICS, "ground_truth_label", "hybrid_label"]
_FEATURES = [c for c in WINDOW_COLUMNS if c not in (*PASSED_THROUGH, "window_id", "timestamp", "label_source")]
Close = Callable[[tuple, pd.DataFrame], pd.DataFrame]


def use_state_store(df: DataFrame) -> None:
    """Keyed list and value state needs the store that keeps them outside the heap."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(parts: Iterator[bytes]) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(p).read_all().to_pandas() for p in parts]
    rows = pd.concat([t for t in tables if len(t)], ignore_index=True) if len(tables) > 1 else tables[0]
    return rows.sort_values(["ts_us", "seq"], kind="stable", ignore_index=True)


class BlockProcessor(StatefulProcessor):
    """Keeps the rows of a (service, block) until the watermark has passed its end.

    ``trim`` drops what a micro-batch brings and no block needs."""

    def __init__(self, block_us: int, close: Close, trim: Callable[[pd.DataFrame], pd.DataFrame] | None = None):
        self.block_us = block_us
        self.close_block = close
        self.trim = trim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.rows.appendValue((_packed(self.trim(part) if self.trim else part),))
        self.handle.registerTimer(int((key[1] + 1) * self.block_us // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = _unpacked(p for (p,) in self.rows.get())
        self.rows.clear()
        yield self.close_block(key, rows)

    def close(self) -> None:
        pass


def _timed(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("timestamp", delay).where(F.col("ts_us").isNotNull() & F.col(KEY).isNotNull())


def _numbers(rows: pd.DataFrame, column: str) -> np.ndarray:
    return pd.to_numeric(rows[column]).to_numpy(float, na_value=np.nan)


def frames_stream(df: DataFrame, settings: Settings = DEFAULTS, delay: str = "2 minutes", block_minutes: int = 5) -> DataFrame:
    """Window rows with features, label and trends of a labelled stream, block by block.

    Needs the pass-through columns of the window table and ``timestamp``."""
    use_state_store(df)
    block_us = block_minutes * MINUTE_US
    halo_us = settings.window_us + TREND_LOOK_BACK_US
    rows = _timed(df, delay).select("timestamp", *PASSED_THROUGH)
    own = [c for c in PASSED_THROUGH if c not in (KEY, "ts_us", "seq", *_READ)]
    copies = F.explode(F.sequence(F.lit(0), F.lit(-(-halo_us // block_us))))
    copied = (
        rows.withColumn("copy", copies)
        .withColumn(BLOCK, slot(F.col("ts_us"), block_us) + F.col("copy"))
        .where((F.col("copy") == 0) | (F.col("ts_us") + halo_us > F.col(BLOCK) * block_us))
        .withColumns({c: F.when(F.col("copy") == 0, F.col(c)) for c in own})
        .withColumn(HOME, F.col("copy") == 0)
        .drop("copy")
    )
    made = ["window_rows bigint", *(f"{c} {'bigint' if c == 'gc_spike_count' else 'double'}" for c in _FEATURES),
            "window_label string", *(f"{c} double" for c in TREND_COLUMNS)]
    schema = StructType([*rows.select(*PASSED_THROUGH).schema, *StructType.fromDDL(", ".join(made))])
    names = schema.fieldNames()

    def close(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ts = rows["ts_us"].to_numpy(np.int64)
        columns = [_numbers(rows, c) for c in ("ram_percent", "cpu_percent", "heap_mb_used", "gc_count")]
        features = frames.frame_features(ts, *columns, (rows["ground_truth_label"] == "FAILURE").to_numpy(), settings)
        kept = features["window_rows"] >= settings.min_window_rows
        windows = rows[kept].assign(**{k: v[kept] for k, v in features.items()})
        windows = windows.assign(**frames.failure_trends(ts[kept], (windows["hybrid_label"] == "FAILURE").to_numpy()))
        mine = windows[windows[HOME]]
        return mine.assign(**{KEY: key[0]})[names]

    return copied.groupBy(KEY, BLOCK).transformWithStateInPandas(
        BlockProcessor(block_us, close), schema, outputMode="Append", timeMode="EventTime"
    )


def windows_to_tables(
    labelled: DataFrame, audit_path: str, ml_path: str, projects: DataFrame, checkpoint: str,
    settings: Settings = DEFAULTS, delay: str = "2 minutes",
) -> DataStreamWriter:
    """Window rows of a labelled stream into the audit and the ML table, exactly once.

    ``projects`` is (stack, project_id). ``ram_std_trend``, which looks back by rows without a
    limit of time, stays empty."""
    found = frames_stream(labelled, settings, delay).withColumns(
        {"timestamp": from_micros(F.col("ts_us")), "label_source": F.lit("ground_truth")}
    )

    def write(windows: DataFrame, batch: int) -> None:
        tables.save_batch(windows, audit_path, ml_path, projects, batch)

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


#: A closed block and its summary.
CLOSED = (
    f"{KEY} string, {BLOCK} bigint, rows binary, {', '.join(f'last_{c} double' for c in METRICS)}, gc_seen bigint, tail array<double>"
)
#: Numbers that one block hands to the next.
CARRY = ", ".join(f"carry_{c} double" for c in METRICS) + ", carry_gc_seen bigint, carry_history array<double>"
_CARRY_NAMES = [part.split(" ")[0] for part in CARRY.split(", ")]


def blocks_stream(df: DataFrame, settings: Settings = DEFAULTS, delay: str = "2 minutes") -> DataFrame:
    """Closed blocks: service, block, rows (packed) and the summary that later blocks need."""
    use_state_store(df)
    back = settings.gc_history_rows - 1
    rows = _timed(df, delay).withColumns(
        {
            BLOCK: slot(F.col("ts_us"), settings.slice_us),
            "gc_word": text.has_gc_word(F.col("log_message")),
            "blank": text.is_blank(F.col("log_message")),
        }
    )

    def close(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return summed_up(key, rows, back)

    return rows.groupBy(KEY, BLOCK).transformWithStateInPandas(
        BlockProcessor(settings.slice_us, close), CLOSED, outputMode="Append", timeMode="EventTime"
    )


def summed_up(key: tuple, rows: pd.DataFrame, back: int) -> pd.DataFrame:
    """One row with the sorted rows of a block and what they hand on."""
    last = {f"last_{c}": _last(_numbers(rows, c)) for c in METRICS}
    filled = pd.Series(_numbers(rows, "gc_count")).ffill()[~rows["blank"].to_numpy(bool)]
    tail = [None if np.isnan(v) else float(v) for v in filled.to_numpy()[-back:]]
    told = {KEY: key[0], BLOCK: key[1], "rows": _packed(rows.drop(columns=[KEY, BLOCK], errors="ignore")), **last}
    return pd.DataFrame([{**told, "gc_seen": int(rows["gc_word"].sum()), "tail": tail}])


def _last(values: np.ndarray) -> float:
    known = values[~np.isnan(values)]
    return known[-1] if len(known) else np.nan


class CarryProcessor(StatefulProcessor):
    """What all blocks of a service so far add up to, from their summaries alone."""

    def __init__(self, back: int):
        self.back = back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("carry", CARRY)

    def _now(self) -> tuple:
        return self.state.get() if self.state.exists() else (*[None] * len(METRICS), 0, [])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Start from what a batch left: one row with the columns of ``CARRY``."""
        row = initialState.iloc[0]
        numbers = [None if pd.isna(row[c]) else float(row[c]) for c in _CARRY_NAMES[: len(METRICS)]]
        self.state.update((*numbers, int(row["carry_gc_seen"]), [float(v) for v in row["carry_history"]]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        blocks = pd.concat(list(rows), ignore_index=True).sort_values(BLOCK)
        *known, seen, history = self._now()
        out = []
        for block in blocks.to_dict("records"):
            out.append((key[0], block[BLOCK], *known, seen, list(history)))
            before = known[METRICS.index("gc_count")]
            told = [before if v is None or np.isnan(v) else float(v) for v in block["tail"]]
            # A row before the first known counter has none; it still takes a place.
            history = [*history, *(np.nan if v is None else v for v in told)][-self.back :]
            known = [k if np.isnan(block[f"last_{c}"]) else float(block[f"last_{c}"]) for c, k in zip(METRICS, known)]
            seen += int(block["gc_seen"])
        self.state.update((*known, seen, history))
        yield pd.DataFrame(out, columns=[KEY, BLOCK, *_CARRY_NAMES])

    def close(self) -> None:
        pass


def carries_stream(blocks: DataFrame, settings: Settings = DEFAULTS, initial: DataFrame | None = None) -> DataFrame:
    """(service, block) and the ``CARRY`` columns, for every closed block of a stream of them.

    ``initial`` has a row per service with those columns, as an earlier batch left them."""
    use_state_store(blocks)
    summaries = blocks.drop("rows")
    grouped = {} if initial is None else {"initialState": initial.groupBy(KEY)}
    return summaries.groupBy(KEY).transformWithStateInPandas(
        CarryProcessor(settings.gc_history_rows - 1), f"{KEY} string, {BLOCK} bigint, {CARRY}",
        outputMode="Append", timeMode="None", **grouped,
    )


def filled_rows(blocks: DataFrame, carries: DataFrame, columns: StructType, settings: Settings = DEFAULTS) -> DataFrame:
    """The rows of closed blocks, metrics filled, with ``gc_seen``, ``blank`` and ``gc_jump``.

    ``columns`` are the columns of the stream to give back; blank messages have no jump."""
    back = settings.gc_history_rows - 1
    schema = StructType([*columns, *StructType.fromDDL("gc_seen bigint, blank boolean, gc_jump double")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch.to_dict("records"):
                rows = _unpacked(iter([block["rows"]]))
                rows[KEY] = block[KEY]
                for c in METRICS:
                    rows[c] = pd.Series(_numbers(rows, c)).ffill().fillna(block[f"carry_{c}"])
                rows["gc_seen"] = block["carry_gc_seen"] + rows["gc_word"].cumsum()
                shown = np.flatnonzero(~rows["blank"].to_numpy(bool))
                before = np.asarray(block["carry_history"], float)
                counts = np.concatenate([before, rows["gc_count"].to_numpy(float)[shown]])
                at = np.arange(len(before), len(counts))
                jump = np.full(len(rows), np.nan)
                jump[shown] = counts[at] - counts[np.maximum(at - back, 0)]
                yield rows.assign(gc_jump=jump)[schema.fieldNames()]

    return blocks.select(KEY, BLOCK, "rows").join(carries, [KEY, BLOCK]).mapInPandas(run, schema)
