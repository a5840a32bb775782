"""Token-id files in Simple-8b: 64-bit words of a 4-bit selector and 60 bits of ids.

Ids are coded in blocks of ``BLOCK``; the offset of every block is kept, so any block can be
decoded alone and many at once. An id of 2**60 or more takes an escape word and a raw word.

A file holds whole documents in ascending doc_id order:

    magic | words of all blocks | doc_id int64 * docs | null flag uint8 * docs |
    ids per document int64 * docs | word offset of each block int64 * blocks |
    docs, ids, blocks, offset of the index as int64 | magic

Edge cases: a null or empty text holds the end id alone. Null doc_ids come first and are read
back as null. Rows that repeat a doc_id are all written, ordered by text. An empty table gives
files without documents. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from failwatch.llm.common import tasks
from failwatch.llm.files import committed, resolve
from failwatch.llm.tokens import tokenizer
from failwatch.llm.words import text_chunks

#: Ids and bits per word of each selector; 0 is the escape, 15 a run of zeros.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
BLOCK = 1024
#: Blocks coded or decoded at a time.
GROUP = 256
MAGIC = b"S8TOKEN1"
END_ID = 1
_U = np.uint64


def _widths(ids: np.ndarray) -> np.ndarray:
    small = np.frexp(np.minimum(ids, _U(1 << 31)).astype(np.float64))[1]
    return np.where(ids < _U(1 << 30), small, np.where(ids < _U(1 << 60), 60, 64)).astype(np.int8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids and the word offset of every block."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = ids
    widths = _widths(padded).reshape(blocks, BLOCK)
    place = np.arange(BLOCK, dtype=np.int16)
    # The selector that holds most ids from each place on. Zeros behind a block fit any word.
    selector = np.zeros((blocks, BLOCK), np.int8)
    for s in sorted(range(1, 16), key=lambda s: COUNTS[s]):
        over = np.where(widths > BITS[s], place, np.int16(2 * BLOCK))
        clear = np.minimum.accumulate(over[:, ::-1], axis=1)[:, ::-1] - place
        selector[clear >= COUNTS[s]] = s
    step = COUNTS[selector].astype(np.int16)
    # All blocks follow their chains of words at once.
    starts = np.zeros((blocks, BLOCK), bool)
    rows, at = np.arange(blocks), np.zeros(blocks, np.int64)
    ends = np.full(blocks, BLOCK)
    if blocks:
        ends[-1] = n - (blocks - 1) * BLOCK
    while len(rows):
        starts[rows, at] = True
        at = at + step[rows, at]
        going = at < ends[rows]
        rows, at = rows[going], at[going]
    flat = np.flatnonzero(starts)
    kinds = selector.ravel()[flat]
    size = 1 + (kinds == 0)
    offsets = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    block_ends = (flat // BLOCK + 1) * BLOCK
    for s in np.unique(kinds).tolist():
        mine = np.flatnonzero(kinds == s)
        if s == 0:
            words[offsets[mine] + 1] = padded[flat[mine]]
        elif s < 15:
            source = flat[mine][:, None] + np.arange(COUNTS[s])
            values = np.where(source < block_ends[mine][:, None], padded[np.minimum(source, len(padded) - 1)], _U(0))
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            words[offsets[mine]] = np.bitwise_or.reduce(values << shifts, axis=1) | (_U(s) << _U(60))
        else:
            words[offsets[mine]] = _U(s) << _U(60)
    per_block = np.bincount(flat // BLOCK, size, blocks).astype(np.int64)
    return words, np.cumsum(per_block) - per_block


def decode(words: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """``total`` ids of successive blocks that begin at ``offsets`` of the words."""
    kinds = (words >> _U(60)).astype(np.int8)
    header = np.ones(len(words), bool)
    after = -1
    for at in np.flatnonzero(kinds == 0).tolist():
        if at != after:  # else it is the raw word of the escape before
            after = at + 1
            header[after] = False
    heads = np.flatnonzero(header)
    kinds = kinds[heads]
    block = np.searchsorted(offsets, heads, "right") - 1
    counts = COUNTS[kinds]
    ends = np.cumsum(counts)
    firsts = ends - counts
    first_of_block = firsts[np.searchsorted(heads, offsets)]
    places = firsts - first_of_block[block] + block * BLOCK
    limits = np.minimum((block + 1) * BLOCK, total)
    out = np.zeros(total, np.uint64)
    for s in np.unique(kinds).tolist():
        mine = np.flatnonzero(kinds == s)
        if s == 0:
            out[places[mine]] = words[heads[mine] + 1]
        elif s < 15:
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            values = (words[heads[mine]][:, None] >> shifts) & _U((1 << int(BITS[s])) - 1)
            target = places[mine][:, None] + np.arange(COUNTS[s])
            inside = target < limits[mine][:, None]
            out[target[inside]] = values[inside]
    return out


class Writer:
    """Writes one file; ids are coded and written as blocks fill."""

    def __init__(self, out):
        self.out, self.pending, self.held = out, [], 0
        self.offsets, self.words, self.ids = [], 0, 0
        self.doc_ids, self.nulls, self.counts = [], [], []
        out.write(MAGIC)

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += [0 if d is None else d for d in doc_ids]
        self.nulls += [d is None for d in doc_ids]
        self.counts += counts.tolist()
        self.pending.append(ids.astype(np.uint64))
        self.held += len(ids)
        if self.held >= GROUP * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending)
        for i in range(0, n, GROUP * BLOCK):
            part = ids[i : min(i + GROUP * BLOCK, n)]
            words, offsets = encode(part)
            self.offsets.append(offsets + self.words)
            self.words += len(words)
            self.ids += len(part)
            self.out.write(words.astype("<u8").tobytes())
        self.pending, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        offsets = np.concatenate(self.offsets) if self.offsets else np.zeros(0, np.int64)
        for column, kind in ((self.doc_ids, "<i8"), (self.nulls, "u1"), (self.counts, "<i8"), (offsets, "<i8")):
            self.out.write(np.asarray(column).astype(kind).tobytes())
        tail = [len(self.doc_ids), self.ids, len(offsets), len(MAGIC) + 8 * self.words]
        self.out.write(np.array(tail, "<i8").tobytes() + MAGIC)


def read_file(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, its ids) of every document, in order."""
    store, target = resolve(path)
    with store.open_input_file(target) as f:
        size = f.size()
        f.seek(size - 40)
        tail = f.read(40)
        if tail[32:] != MAGIC:
            raise ValueError(f"{path} is not a whole token file")
        docs, total, blocks, index = np.frombuffer(tail[:32], "<i8").tolist()
        f.seek(index)
        doc_ids = np.frombuffer(f.read(8 * docs), "<i8")
        nulls = np.frombuffer(f.read(docs), "u1")
        counts = np.frombuffer(f.read(8 * docs), "<i8")
        offsets = np.append(np.frombuffer(f.read(8 * blocks), "<i8"), (index - len(MAGIC)) // 8)
        held, first, block = np.zeros(0, np.uint32), 0, 0
        for doc_id, null, n in zip(doc_ids.tolist(), nulls.tolist(), counts.tolist()):
            parts, have = [held], len(held)
            while have < n:
                end = min(block + GROUP, blocks)
                f.seek(len(MAGIC) + 8 * int(offsets[block]))
                words = np.frombuffer(f.read(8 * int(offsets[end] - offsets[block])), "<u8")
                ids = decode(words, offsets[block:end] - offsets[block], min(end * BLOCK, total) - block * BLOCK)
                parts.append(ids.astype(np.uint32))
                have, block = have + len(ids), end
            if len(parts) > 1:
                held = np.concatenate(parts)
            yield None if null else doc_id, first, held[:n]
            held, first = held[n:], first + n


def write_tokens(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Write the files, in ascending doc_id order over file names; (path, documents, ids) of each.

    The list has one entry per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.s8b"
        units = tokenizer(tokenizer_path)
        with committed(path) as out:
            writer = Writer(out)
            for batch in batches:
                for first, end, data, offsets in text_chunks(batch["text"]):
                    ids, rows = units.encode(data, offsets)
                    # The end id goes behind each document.
                    ids = np.insert(ids, rows[1:], end_id)
                    writer.add(batch["doc_id"].slice(first, end - first).to_pylist(), np.diff(rows) + 1, ids)
            writer.close()
        yield pa.record_batch([pa.array([path]), pa.array([len(writer.counts)]), pa.array([writer.ids])], ["path", "docs", "ids"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Rows of one doc_id, null for instance, are split by the beginnings of their texts.
    ranges = rows.repartitionByRange(tasks(documents), "doc_id", F.substring("text", 1, 64))
    ordered = ranges.sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(run, "path string, docs bigint, ids bigint").collect()
    return sorted((r.path, r.docs, r.ids) for r in written)


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (uint32, little endian)."""
    starts = np.cumsum([0, *(ids for _, _, ids in files)]).tolist()
    parts = [(path, start) for (path, docs, _), start in zip(files, starts) if docs]
    plan = spark.createDataFrame(parts, "path string, base bigint").repartition(max(1, len(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                rows, size = [], 0
                for doc_id, first, ids in read_file(path):
                    rows.append((doc_id, base + first, len(ids), ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size > 1 << 22:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return plan.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
