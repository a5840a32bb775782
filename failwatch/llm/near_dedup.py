"""MinHash near-dedup with HyperMinHash registers and exact confirmation.

1. Each text becomes its set of word shingles (64-bit hashes). For every one of K hash
   functions the least value is kept as a HyperMinHash register: the count of leading zeros
   and the mantissa bits after them, 16 bits in all. One function per register, rather than
   one function dealt over buckets, since short texts would leave most buckets empty.
2. Texts with equal sets form one class. Registers of the classes are banded; classes that
   share a band value are connected, which gives candidate groups. No pairs are formed.
3. In each candidate group a pivot block of at most ``BLOCK`` classes is compared with all
   classes of the group: first the Jaccard similarity estimated from the registers, corrected
   for chance collisions, then the exact one on full sets. Classes outside the largest
   confirmed component that were no pivots are then compared, in blocks of ``BLOCK``, with the
   whole group. Every link has an end among those or both ends in one component, so the
   components are exact over all candidate pairs, whatever the size of a group.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with
nothing. A text of fewer words than the shingle size has its whole sequence as one shingle.
Rows that repeat a doc_id share its links and component. A null doc_id is linked with nothing,
its component is null and it is kept. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from failwatch.llm.common import tasks
from failwatch.llm.components import connected_components
from failwatch.llm.words import BLANK_SEPARATED, mix, shingle_sets, text_chunks, word_hashes
from failwatch.storage import materialize

BAND_ROWS = 6
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-4
MANTISSA_BITS = 10
BLOCK = 512
#: Rows of a group that one task compares with a pivot block.
STREAM = 2048
#: Expected share of chance collisions of disjoint, equally large sets, times 2**-bits.
COLLISIONS = 0.169919487159739
#: Standard errors by which an estimate may miss the threshold before the exact test.
SLACK = 5.0
_U = np.uint64


def bands_for(similarity: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at the threshold shares none with chance ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(similarity, 1 - 1e-9) ** rows)))


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    return seeds[:count] | _U(1), seeds[count:]


def registers(minima: np.ndarray) -> np.ndarray:
    """16-bit HyperMinHash registers of 64-bit minima: leading zeros, then mantissa bits."""
    top = np.where(minima > 0, minima, _U(1))
    zeros = 63 - np.frexp(top.astype(np.float64))[1].astype(np.int64) + 1
    # The conversion rounds up to the next power of two at times.
    zeros = np.clip(zeros, 0, 63)
    zeros += ((top << zeros.astype(np.uint64)) >> _U(63) == 0) & (zeros < 63)
    mantissa = (top << np.minimum(zeros + 1, 63).astype(np.uint64)) >> _U(64 - MANTISSA_BITS)
    return (np.minimum(zeros, 62).astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, size_a: float, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of register rows, less the expected chance collisions."""
    equal = (a == b).mean(axis=1)
    chance = COLLISIONS * 4 * size_a * size_b / np.maximum(size_a + size_b, 1) ** 2 * 2.0**-MANTISSA_BITS
    return (equal - chance) / (1 - chance)


def sketch_sets(shingles: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """Registers of every set, zeros for an empty one."""
    n = np.diff(offsets)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), count), np.uint16)
    if len(full):
        minima = np.empty((len(full), count), np.uint64)
        factors, terms = multipliers(count)
        firsts = offsets[:-1][full]
        values = np.empty_like(shingles)
        for j in range(count):
            np.multiply(shingles, factors[j], out=values)
            values += terms[j]
            minima[:, j] = np.minimum.reduceat(values, firsts)
        out[full] = registers(minima)
    return out


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in text_chunks(texts):
        yield first, end, *shingle_sets(*word_hashes(data, offsets, BLANK_SEPARATED), words)


def fingerprints(documents: DataFrame, words: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, two digests of the set, register bytes and band values."""
    count = bands * BAND_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, shingles, offsets in _sets(batch["text"], words):
                n = np.diff(offsets)
                digests = []
                for salt in (_U(0x632BE59BD9B4E019), _U(0xE220A8397B1DCDAF)):
                    sums = np.concatenate([[_U(0)], np.cumsum(mix(shingles ^ salt))])
                    digests.append(mix(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
                regs = sketch_sets(shingles, offsets, count)
                keys = np.zeros((end - first, bands), np.uint64)
                for r in range(BAND_ROWS):
                    keys = mix(keys * _U(0xC2B2AE3D27D4EB4F) + regs[:, r::BAND_ROWS][:, :bands])
                keys = mix(keys + np.arange(bands, dtype=np.uint64))
                packed = regs.tobytes()
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"].slice(first, end - first),
                        "n_shingles": pa.array(n.astype(np.int64)),
                        "set_a": pa.array(digests[0]),
                        "set_b": pa.array(digests[1]),
                        "registers": pa.array([packed[i * 2 * count : (i + 1) * 2 * count] for i in range(end - first)], pa.binary()),
                        "bands": pa.ListArray.from_arrays(
                            pa.array(np.arange(0, (end - first + 1) * bands, bands, dtype=np.int32)),
                            pa.array(keys.ravel().view(np.int64)),
                        ),
                    }
                )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, registers binary, bands array<bigint>"
    )


class _Links:
    """Union-find over the classes one block meets; reports each merge once."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    def merge(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


class _Block:
    """The shingle sets of a pivot block as postings: for each shingle the pivots that have it."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], regs: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.registers = np.array(regs)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.keys, self.firsts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.firsts[1:], len(flat))

    def linked(self, shingles: np.ndarray, regs: np.ndarray, similarity: float) -> np.ndarray:
        """Pivots whose estimate is near enough and whose exact similarity reaches the threshold."""
        n = len(shingles)
        # Beyond these sizes no intersection can reach the threshold.
        fit = (100 * np.minimum(self.sizes, n) >= round(100 * similarity) * np.maximum(self.sizes, n)).nonzero()[0]
        if not len(fit):
            return fit
        slack = SLACK * math.sqrt(similarity * (1 - similarity) / len(regs))
        fit = fit[estimate(self.registers[fit], regs, n, self.sizes[fit]) >= similarity - slack]
        if not len(fit):
            return fit
        at = np.searchsorted(self.keys, shingles)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == shingles]
        lengths = self.ends[at] - self.firsts[at]
        total = int(lengths.sum())
        place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.firsts[at], lengths)
        common = np.bincount(self.owners[place], minlength=len(self.ids))[fit]
        union = self.sizes[fit] + n - common
        return fit[100 * common >= round(100 * similarity) * union]


def confirmed(work: DataFrame, words: int, similarity: float, parts: int) -> DataFrame:
    """Edges (a, b) that connect what is linked, exactly, between pivots and rows of each task key.

    ``work`` has key, pivot (boolean), node, registers and text; pivots of a key come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, links, pivots = None, None, _Links(), ([], [], [])
        for batch in batches:
            keys, is_pivot = batch["key"].to_pylist(), batch["pivot"].to_pylist()
            nodes, packed = batch["node"].to_pylist(), batch["registers"].to_pylist()
            found = []
            for first, end, shingles, offsets in _sets(batch["text"], words):
                for i in range(end - first):
                    row, mine = first + i, shingles[offsets[i] : offsets[i + 1]]
                    regs = np.frombuffer(packed[row], np.uint16)
                    if keys[row] != key:
                        key, block, links, pivots = keys[row], None, _Links(), ([], [], [])
                    if is_pivot[row]:
                        for column, value in zip(pivots, (nodes[row], mine.copy(), regs)):
                            column.append(value)
                        continue
                    if not pivots[0]:
                        continue
                    block = block or _Block(*pivots)
                    for other in block.ids[block.linked(mine, regs, similarity)].tolist():
                        if links.merge(nodes[row], other):
                            found.append((nodes[row], other))
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    ordered = work.repartition(parts, "key").sortWithinPartitions("key", F.desc("pivot"))
    return ordered.select("key", "pivot", "node", "registers", "text").mapInArrow(run, "a bigint, b bigint")


def _work(members: DataFrame, blocks: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``confirmed``: each block of pivots with every slice of its candidate group."""
    members = members.select("node", "group", "slice")
    per_group = blocks.select("group", "block").distinct()
    streamed = members.join(per_group, "group").select("node", F.xxhash64("group", "block", "slice").alias("key"), F.lit(False).alias("pivot"))
    slices = members.select("group", "slice").distinct()
    pivots = blocks.join(slices, "group").select("node", F.xxhash64("group", "block", "slice").alias("key"), F.lit(True).alias("pivot"))
    return streamed.union(pivots).join(classes, "node").join(texts, "node")


def _link_edges(documents: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges between class representatives whose components are those of all confirmed links."""
    parts = tasks(documents)
    full = prints.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")).select("node", "set_a", "set_b")
    classes = materialize(
        full.withColumnRenamed("doc_id", "node").join(reps, ["node", "set_a", "set_b"], "left_semi").dropDuplicates(["node", "set_a", "set_b"]), "classes"
    )
    banded = classes.select("node", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    shared = banded.join(leaders, "band").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    groups = connected_components(shared).withColumnRenamed("component", "group")
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    groups = materialize(
        groups.join(sizes, "group").select(
            "node", "group", "size",
            F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / STREAM)).alias("slice"),
            F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("size") / BLOCK)).alias("block"),
        ),
        "groups",
    )
    kept = classes.select("node", "registers")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(groups, "node", "left_semi")
    texts = materialize(texts, "candidate-texts")
    first = groups.where("block = 0").select("node", "group", "block")
    edges = materialize(confirmed(_work(groups, first, kept, texts), words, similarity, parts), "links")
    # Groups of one block are done. In the others, whatever is neither a pivot of the first
    # block nor in the largest confirmed component is compared with the whole group.
    large = groups.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return edges
    found = connected_components(edges)
    large = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = large.groupBy("group", "component").agg(F.count("*").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "component"))).where("rank = 1")
    rest = (
        large.join(best.select("group", "component"), ["group", "component"], "left_anti")
        .where("block > 0")
        .select("node", "group", "block")
    )
    rest = materialize(rest, "unsettled")
    if rest.isEmpty():
        return edges
    again = groups.join(rest.select("group").distinct(), "group", "left_semi")
    more = confirmed(_work(again, rest, kept, texts), words, similarity, parts)
    return edges.union(materialize(more, "links"))


def near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept.

    Two documents are linked when their shingle sets have a Jaccard similarity of at least
    ``similarity`` (to two decimals)."""
    prints = materialize(fingerprints(documents, words, bands_for(similarity)), "fingerprints")
    edges = _link_edges(documents, prints, words, similarity)
    full = prints.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    same = full.select("doc_id", "set_a", "set_b").join(reps, ["set_a", "set_b"]).where("doc_id <> rep")
    # Every node is the representative of a class or hangs on one by a single edge.
    components = connected_components(edges.union(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    return (
        prints.select("doc_id", "n_shingles")
        .join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without all but the first of each component, all their columns."""
    dropped = near_duplicates(documents, words, similarity).where("not kept").select(F.col("doc_id").alias("dropped_id"))
    return documents.join(dropped.distinct(), documents["doc_id"] == dropped["dropped_id"], "left_anti")
