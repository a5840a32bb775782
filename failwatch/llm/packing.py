"""Packing documents into windows: least squares over length combinations, then greedy.

A document is its token ids and the end id. Its full windows are sequences of their own; the
remainder, 1 to capacity - 1 ids, is packed:

1. The histogram of remainder lengths (fewer than ``capacity`` rows) goes to the driver.
   Combinations of two and of three lengths that fill a window exactly are enumerated; their
   repeat counts x >= 0 minimise |A x - h|^2 (non-negative least squares, by coordinates), are
   rounded down and bounded by what is there.
2. Within a length, remainders are ranked; ranks are dealt to the combinations in ranges. The
   table of ranges is bounded by the number of combinations and is broadcast.
3. What is left is packed greedily one after another, cut where a window is full, so only the
   last sequence is short.

Ranks and offsets are taken in slices of hashed rows with one row per slice combined on top, so
no length and no document holds up a task.

Edge cases: a null or empty text is the end id alone. Rows that repeat a doc_id are packed each
on its own, a null doc_id is carried as it is. An empty table gives no piece. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from failwatch.llm.common import tasks
from failwatch.llm.tokens import tokenizer
from failwatch.llm.words import text_chunks
from failwatch.storage import materialize, new_path

CAPACITY = 2048
END_ID = 1
#: Lengths, the most frequent ones, that triples are built from.
TRIPLE_LENGTHS = 48
SWEEPS = 40


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Pairs of all lengths and triples of frequent lengths that fill a window."""
    pairs = [(a, capacity - a) for a in sorted(histogram) if a <= capacity - a and capacity - a in histogram]
    frequent = sorted(histogram, key=lambda x: (-histogram[x], x))[:TRIPLE_LENGTHS]
    triples = {
        tuple(sorted((a, b, capacity - a - b)))
        for a in frequent for b in frequent
        if capacity - a - b in histogram
    }
    return pairs + sorted(triples)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of the combinations used; no length is used more often than it is there."""
    combos = combinations(histogram, capacity)
    columns = [[(length, combo.count(length)) for length in set(combo)] for combo in combos]
    left = {k: float(v) for k, v in histogram.items()}
    x = [0.0] * len(combos)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, column in enumerate(columns):
            step = sum(left[k] * m for k, m in column) / sum(m * m for _, m in column)
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, m in column:
                    left[k] -= m * step
        if moved < 0.1:
            break
    there, used = dict(histogram), []
    for j in sorted(range(len(combos)), key=lambda j: (-x[j], combos[j])):
        n = min([int(x[j]), *(there[k] // m for k, m in columns[j])])
        if n > 0:
            used.append((combos[j], n))
            for k, m in columns[j]:
                there[k] -= m * n
    return used


def tokenize(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n and ids with the end id; ids as 2 bytes each where all fit, else 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = tokenizer(tokenizer_path)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch["text"]):
                ids, rows = units.encode(data, offsets)
                ids = np.insert(ids, rows[1:], end_id)
                bounds = rows + np.arange(len(rows))
                ids = ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"].slice(first, end - first),
                        "n": pa.array(np.diff(bounds)),
                        "ids": pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    }
                )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n bigint, ids binary"
    )


def assign(rows: DataFrame, capacity: int = CAPACITY, slices: int = 64) -> DataFrame:
    """uid, first_full (sequence of its first full window), sequence and place of its remainder.

    ``rows`` has uid, unique, and n, the ids of the document."""
    cut = materialize(
        rows.select(
            "uid", "n", F.floor(F.col("n") / capacity).alias("full"), (F.col("n") % capacity).alias("rest"),
            F.pmod(F.xxhash64("uid"), F.lit(slices)).alias("slice"),
        ),
        "cut",
    )
    spark = rows.sparkSession
    histogram = {r["rest"]: r["count"] for r in cut.where("rest > 0").groupBy("rest").count().collect()}
    full = cut.agg(F.sum("full")).first()[0] or 0
    used = solve(histogram, capacity)
    ranges, taken, sequence = [], dict.fromkeys(histogram, 0), full
    for combo, n in used:
        place = 0
        for length in combo:
            ranges.append((length, taken[length], taken[length] + n, sequence, place))
            taken[length] += n
            place += length
        sequence += n
    # At most three rows per combination.
    ranges = spark.createDataFrame(ranges, "rest bigint, low bigint, high bigint, base bigint, place bigint")
    by_length = cut.groupBy("rest", "slice").agg(F.count("*").alias("m"))
    before = Window.partitionBy("rest").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_length = by_length.select("rest", "slice", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    mine = Window.partitionBy("slice", "rest").orderBy("uid")
    ranked = cut.withColumn("own", F.row_number().over(mine) - 1).join(by_length, ["rest", "slice"])
    placed = ranked.withColumn("rank", F.col("own") + F.col("ahead")).join(
        F.broadcast(ranges.withColumnRenamed("rest", "length")),
        (F.col("rest") == F.col("length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
        "left",
    )
    placed = materialize(
        placed.select(
            "uid", "slice", "full", "rest", (F.col("base") + F.col("rank") - F.col("low")).alias("sequence"), "place",
            F.when(F.col("low").isNull(), F.col("rest")).otherwise(0).alias("left_over"),
        ),
        "placed",
    )
    # One row per slice.
    sums = placed.groupBy("slice").agg(F.sum("full").alias("f"), F.sum("left_over").alias("r"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "slice", F.coalesce(F.sum("f").over(ahead), F.lit(0)).alias("full_ahead"), F.coalesce(F.sum("r").over(ahead), F.lit(0)).alias("rest_ahead")
    )
    own = Window.partitionBy("slice").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.select(
        "*", F.coalesce(F.sum("full").over(own), F.lit(0)).alias("f"), F.coalesce(F.sum("left_over").over(own), F.lit(0)).alias("r")
    ).join(F.broadcast(sums), "slice")
    at = F.col("r") + F.col("rest_ahead")
    return offsets.select(
        "uid",
        (F.col("f") + F.col("full_ahead")).alias("first_full"),
        F.coalesce("sequence", F.lit(sequence) + F.floor(at / capacity)).alias("sequence"),
        F.coalesce("place", at % capacity).alias("place"),
    )


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (uint32) of every piece."""
    spark = documents.sparkSession
    path = new_path(spark, "token-ids")
    coded = tokenize(documents, tokenizer_path, end_id).withColumn("uid", F.monotonically_increasing_id())
    coded.write.option("compression", "zstd").parquet(path)
    coded = spark.read.schema(coded.schema).parquet(path)
    plan = assign(coded.select("uid", "n"), capacity, tasks(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            out, size = [], 0
            columns = [batch[c].to_pylist() for c in ("doc_id", "n", "first_full", "sequence", "place")]
            for i, (doc_id, n, first_full, sequence, place) in enumerate(zip(*columns)):
                raw = batch["ids"][i].as_py()
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                whole = n // capacity
                cuts = [(k * capacity, capacity, first_full + k, 0) for k in range(whole)]
                rest = n - whole * capacity
                if rest:
                    head = min(rest, capacity - place)
                    cuts.append((whole * capacity, head, sequence, place))
                    if rest > head:
                        cuts.append((whole * capacity + head, rest - head, sequence + 1, 0))
                for start, length, seq, offset in cuts:
                    out.append((doc_id, start, length, n, seq, offset, ids[start : start + length].tobytes()))
                size += 4 * n
                if size > 1 << 22:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    rows = coded.join(plan, "uid").select("doc_id", "n", "first_full", "sequence", "place", "ids")
    return rows.mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    )
