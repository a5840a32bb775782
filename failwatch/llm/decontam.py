"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of words (runs of letters and digits, lower case; in scripts
without blanks, such as Chinese or Thai, every character is a word), edits are word edits. An
item leaks into a document that has a stretch of words within ``floor(rate * n)`` edits of the
item's n words. An item of fewer than ``MIN_WORDS`` words leaks where all its words stand in a
row unchanged: such items are found by a hash of their words, and compared. Longer items of similar length form a class that is searched with windows of its
least length, one starting at every word of every document:

1. A window can only match if enough of its word pairs occur in some item, as one edit breaks
   at most two pairs. This filter loses nothing.
2. The CGK random walk embeds window and item prefix: at step t the word x under the cursor is
   put out and the cursor advances by a random bit of (t, x). Few edits become a small
   Hamming distance. Each repetition samples ``SAMPLED`` steps for each of ``TABLES`` tables;
   a window that agrees with an item in one table is a candidate. The number of repetitions
   follows from ``target_recall``.
3. Candidates are verified by the exact edit distance to the best end of the stretch.

Items are sent to the tasks in blocks of about ``BLOCK_WORDS`` words, so any number of items
works: each block is one scan of the documents. Results are one row per document and item.

Edge cases: null or empty texts and items match nothing, nor do items of one word or of fewer
than ``MIN_BYTES`` bytes of words, which say nothing about a leak. A null doc_id or item_id is
carried as it is; texts may have any length. Repeated rows give repeated results. Columns other than the ids and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from failwatch.llm.words import LOWER, letter_spans, mix, span_hashes, text_chunks

#: Words from which an item may have edits.
MIN_WORDS = 8
#: UTF-8 bytes in the words of the shortest item: 16 Latin letters, six Chinese characters.
MIN_BYTES = 16
#: Word edits allowed, as a share of the item's words.
EDIT_RATE = 0.2
BLOCK_WORDS = 1_000_000
CLASS_RATIO = 1.2
SAMPLED = 3
TABLES = 16
TARGET_RECALL = 0.99
#: Text searched at a time: large enough that few windows pass through many small steps.
CHUNK_BYTES = 1 << 22
#: Share of embedded steps that agree at the largest distance, as measured (tests).
AGREEMENT = 0.45
_U = np.uint64
_PAIR = _U(0xC2B2AE3D27D4EB4F)
_PAD = _U(0x27D4EB2F165667C5)


def repetitions(target_recall: float) -> int:
    """Walks so that a pair at the largest distance meets in a table with this chance."""
    one = AGREEMENT**SAMPLED
    return max(1, math.ceil(math.log(1 - target_recall) / math.log1p(-one) / TABLES))


def item_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, each row's first word, and the bytes of each word."""
    starts, ends, rows = letter_spans(data, offsets)
    return span_hashes(LOWER[data], starts, ends), rows, ends - starts


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * _PAIR + words[1:])


class Walk:
    """One CGK walk over windows of ``size`` words, and its sampled tables."""

    def __init__(self, size: int, repetition: int):
        self.size = size
        self.steps = max(SAMPLED, 3 * size // 2)
        draws = np.random.default_rng([size, repetition])
        self.seeds = draws.integers(1, 2**63, self.steps // 64 + 1, dtype=np.uint64)
        self.sampled = [np.sort(draws.choice(self.steps, SAMPLED, replace=False)) for _ in range(TABLES)]

    def signatures(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of table signatures for every window start."""
        at = np.zeros(len(starts), np.int64)
        out = np.zeros((TABLES, len(starts)), np.uint64)
        uses = [[z for z, steps in enumerate(self.sampled) if t in steps] for t in range(self.steps)]
        last = max(int(s[-1]) for s in self.sampled)
        for t in range(last + 1):
            inside = at < self.size
            here = np.where(inside, words[starts + np.minimum(at, self.size - 1)], _PAD)
            for z in uses[t]:
                out[z] = mix(out[z] * _PAIR + here)
            at += ((mix(here ^ self.seeds[t // 64]) >> _U(t % 64)) & _U(1)).astype(np.int64)
        return out


class ItemClass:
    """Items of similar length, with the tables of their embedded prefixes."""

    def __init__(self, ids: list, items: list[np.ndarray], rate: float, walks: int):
        self.ids, self.items = ids, items
        self.size = min(map(len, items))
        self.edits = [int(rate * len(x)) for x in items]
        self.pairs_needed = max(1, self.size - 1 - 2 * max(self.edits))
        self.walks = [Walk(self.size, r) for r in range(walks)]
        words = np.concatenate(items)
        starts = np.cumsum([0, *map(len, items)])[:-1]
        self.tables = []
        for walk in self.walks:
            for row in walk.signatures(words, starts):
                order = np.argsort(row, kind="stable")
                self.tables.append((row[order], order))

    def candidates(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (window, item) pairs that agree in a table, as window * items + item."""
        found = []
        for r, walk in enumerate(self.walks):
            for z, row in enumerate(walk.signatures(words, starts)):
                keys, order = self.tables[r * TABLES + z]
                low, high = np.searchsorted(keys, row, "left"), np.searchsorted(keys, row, "right")
                n = high - low
                hit = np.flatnonzero(n)
                if len(hit):
                    window = np.repeat(hit, n[hit])
                    place = np.arange(len(window)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit]) + np.repeat(low[hit], n[hit])
                    found.append(window * len(self.items) + order[place])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def edit_distances(item: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int) -> np.ndarray:
    """Least word edits that turn the item into words[s:e] for any e, for every start s."""
    width = len(item) + edits
    columns = np.arange(width)
    at = starts[:, None] + columns
    inside = at < ends[:, None]
    windows = np.where(inside, words[np.minimum(at, len(words) - 1)], _U(0))
    ladder = np.arange(width + 1, dtype=np.int32)
    far = np.int32(len(item) + width + 1)
    best = np.tile(ladder, (len(starts), 1))
    for word in item:
        above = best[:, :-1] + np.where(inside & (windows == word), np.int32(0), np.int32(1))
        new = np.empty_like(best)
        new[:, 0] = best[:, 0] + 1
        new[:, 1:] = np.minimum(above, best[:, 1:] + 1)
        best = np.minimum.accumulate(new - ladder, axis=1) + ladder
    best[:, 1:][~inside] = far
    return best.min(axis=1)


class PairSet:
    """Pairs of neighbouring words, behind a table of marks that most others fail."""

    def __init__(self, pairs: list[np.ndarray]):
        self.pairs = np.unique(np.concatenate(pairs or [np.zeros(0, np.uint64)]))
        self.marks = np.zeros(1 << 18, bool)
        self.marks[(self.pairs & _U(len(self.marks) - 1)).astype(np.int64)] = True

    def known(self, pairs: np.ndarray) -> np.ndarray:
        known = self.marks[(pairs & _U(len(self.marks) - 1)).astype(np.int64)]
        some = np.flatnonzero(known)
        at = np.searchsorted(self.pairs, pairs[some])
        at[at == len(self.pairs)] = 0
        known[some] = self.pairs[at] == pairs[some]
        return known


class ShortItems:
    """Items of ``size`` words, found unchanged by the hash of their words."""

    def __init__(self, ids: list, items: list[np.ndarray]):
        self.size, words = len(items[0]), np.stack(items)
        keys = self._keys(words.ravel(), np.arange(len(items)) * self.size)
        order = np.argsort(keys, kind="stable")
        self.keys, self.words, self.ids = keys[order], words[order], [ids[i] for i in order]

    def _keys(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        keys = np.zeros(len(starts), np.uint64)
        for k in range(self.size):
            keys = mix(keys * _PAIR + words[starts + k])
        return keys

    def found(self, words: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, object, int, int]]:
        """(row, item id, first start in the row, 0) for the starts, which are ascending."""
        keys = self._keys(words, starts)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        hit = np.flatnonzero(high > low)
        hit = hit[(words[starts[hit][:, None] + np.arange(self.size)] == self.words[low[hit]]).all(axis=1)]
        # The first of all places of a text in a row, then the items that share the text.
        _, least = np.unique(np.stack([owner[hit], low[hit]]), axis=1, return_index=True)
        for i in hit[np.sort(least)].tolist():
            for item in range(int(low[i]), int(high[i])):
                yield int(owner[i]), self.ids[item], int(starts[i]), 0


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str], rate: float, target_recall: float):
        chunks = list(text_chunks(pa.array(texts, pa.string())))
        split, sizes = [], []
        for _, _, data, offsets in chunks:
            words, rows, lengths = item_words(data, offsets)
            split += [words[a:b] for a, b in zip(rows[:-1], rows[1:])]
            sizes += [int(lengths[a:b].sum()) for a, b in zip(rows[:-1], rows[1:])]
        by_length = sorted((i for i in range(len(split)) if len(split[i]) > 1 and sizes[i] >= MIN_BYTES), key=lambda i: len(split[i]))
        long, short = [i for i in by_length if len(split[i]) >= MIN_WORDS], [i for i in by_length if len(split[i]) < MIN_WORDS]
        self.classes, walks, group = [], repetitions(target_recall), []
        for i in [*long, None]:
            if group and (i is None or len(split[i]) > CLASS_RATIO * len(split[group[0]])):
                self.classes.append(ItemClass([ids[g] for g in group], [split[g] for g in group], rate, walks))
                group = []
            group.append(i)
        self.pairs = PairSet([_pairs(split[i]) for i in long])
        self.short = [ShortItems([ids[i] for i in own], [split[i] for i in own]) for own in (list(g) for _, g in groupby(short, lambda i: len(split[i])))]
        self.openings = PairSet([_pairs(split[i][:2]) for i in short])

    def leaks(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, object, int, int]]:
        """(row, item id, first word in the row, edits), the best stretch of each row and item."""
        if len(words) < 2:
            return []
        pairs = _pairs(words)
        return [
            (row, item, start - int(rows[row]), edits)
            for row, item, start, edits in (*self._short_leaks(words, rows, pairs), *self._long_leaks(words, rows, pairs))
        ]

    def _short_leaks(self, words: np.ndarray, rows: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, object, int, int]]:
        if self.short:
            starts = np.flatnonzero(self.openings.known(pairs))
            owner = np.searchsorted(rows, starts, "right") - 1
            left = rows[owner + 1] - starts
            for items in self.short:
                enough = left >= items.size
                yield from items.found(words, starts[enough], owner[enough])

    def _long_leaks(self, words: np.ndarray, rows: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, object, int, int]]:
        if not self.classes:
            return
        known = np.zeros(len(words), np.int32)
        np.cumsum(self.pairs.known(pairs), out=known[1:])
        # Starts with too few known pairs for every class, within the longest window, go first.
        longest, fewest = self.classes[-1].size, min(c.pairs_needed for c in self.classes)
        reach = known[np.minimum(np.arange(longest - 1, longest - 1 + len(words)), len(words) - 1)]
        able = np.flatnonzero(reach - known >= fewest)
        of = np.searchsorted(rows, able, "right") - 1
        row_ends = rows[of + 1]
        best: dict[tuple[int, int, int], tuple[int, int]] = {}
        for k, c in enumerate(self.classes):
            # Stretches may be shorter than the item, at the end of a row, by the edits allowed.
            enough = known[np.minimum(able + c.size, row_ends) - 1] - known[able] >= c.pairs_needed
            enough &= row_ends - able >= c.size - max(c.edits)
            starts, ends, owner = able[enough], row_ends[enough], of[enough]
            if not len(starts):
                continue
            # Windows at the end of a row are filled up with the padding word.
            pad = np.concatenate([words, np.full(c.size, _PAD)])
            if (ends - starts < c.size).any():
                codes = self._row_bound(c, pad, starts, ends)
            else:
                codes = c.candidates(pad, starts)
            window, item = codes // len(c.items), codes % len(c.items)
            for i in np.unique(item).tolist():
                mine = window[item == i]
                for part in np.array_split(mine, len(mine) // 4096 + 1):
                    edits = edit_distances(c.items[i], words, starts[part], ends[part], c.edits[i])
                    for at in np.flatnonzero(edits <= c.edits[i]).tolist():
                        key, value = (int(owner[part[at]]), k, i), (int(edits[at]), int(starts[part[at]]))
                        best[key] = min(value, best.get(key, value))
        for (row, k, i), (edits, start) in sorted(best.items()):
            yield row, self.classes[k].ids[i], start, edits

    @staticmethod
    def _row_bound(c: ItemClass, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Candidates of windows that are cut at the end of their row."""
        at = starts[:, None] + np.arange(c.size)
        cut = np.where(at < ends[:, None], words[at], _PAD)
        return c.candidates(cut.ravel(), np.arange(len(starts)) * c.size)


def contamination(documents: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, item_id, first_word and edits of every item found in a document."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower("text").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / (5 * BLOCK_WORDS)))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    spark = documents.sparkSession

    def search(block: int) -> DataFrame:
        # One block of items at a time goes through the driver, about BLOCK_WORDS words.
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(Items([r.item_id for r in mine], [r.text for r in mine], rate, target_recall))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch["doc_id"]
                for first, _, data, offsets in text_chunks(batch["text"], CHUNK_BYTES):
                    found = sent.value.leaks(*item_words(data, offsets)[:2])
                    if found:
                        row, item, start, edits = zip(*found)
                        yield pa.record_batch(
                            [ids.take(pa.array([first + r for r in row], pa.int64())),
                             pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(edits, pa.int64())],
                            ["doc_id", "item_id", "first_word", "edits"],
                        )

        return texts.mapInArrow(run, "doc_id bigint, item_id bigint, first_word bigint, edits bigint")

    return reduce(DataFrame.union, [search(b) for b in range(blocks)])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those into which a benchmark item has leaked, all their columns."""
    found = contamination(documents, benchmark).select(F.col("doc_id").alias("leaked_id")).where("leaked_id is not null").distinct()
    return documents.join(found, documents["doc_id"] == found["leaked_id"], "left_anti")
