"""Collocations: Toivonen mining of frequent phrases, scored by their weakest cut.

H. Toivonen, "Sampling Large Databases for Association Rules", VLDB 1996.

1. A sample of the documents proposes phrases of one to ``MOST_WORDS`` words, per language.
2. One pass over all documents counts the proposals and their negative border exactly: every word;
   every longer phrase whose first and last part, each one word shorter, are both proposed. So a
   phrase that was not proposed is counted as soon as its parts were.
3. A border phrase that turns out frequent is a failure: longer phrases with it may be missing. It
   is then added, and a further pass counts what the larger border holds beyond the old one,
   until no border phrase fails. What is frequent does not depend on the sample.

Passes count 62-bit hashes of phrases, summed in arrays over a stretch of text and again by Spark
on the map side, so a frequent phrase is no hot key. Phrases that share a hash share a sum, so
nothing frequent can be missed; a last pass counts the phrases themselves, whose sums are exact.
Proposals reach the tasks as one bit set per phrase length, 2^``FILTER_BITS`` bits whatever the
corpus: a phrase that shares the bit of a proposal is counted, too, which costs time and changes
nothing.

Scores are exact: decimals of 38 digits hold products of counts up to 10^16.

Edge cases: a null text is empty; a null language is ``und``; a text without words counts
nothing; repeated rows count again; ids do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from failwatch.llm.words import LOWER, byte_table, mix, span_hashes
from failwatch.storage import materialize

MOST_WORDS = 3
LEAST_COUNT = 10
LARGER_SHARE = 50
TOP = 2000
UNKNOWN = "und"
#: One document in so many is sampled; a phrase is proposed when the sample holds it so often.
SAMPLE = 4
SAMPLE_COUNT = 2
FILTER_BITS = 24
#: Bytes of text that are summed before phrases leave a task.
STRETCH_BYTES = 2 << 20
#: Hashes that are held and added up over stretches before they leave a task.
HELD = 2_000_000
#: Phrases that leave a task in one batch.
BATCH = 100_000
#: Parts of a language that are ranked before the whole.
RANK_PARTS = 64
#: Characters that end a piece, and blanks between words; fixed by the definition of a phrase.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_WORD = byte_table(ENDS + BLANKS)
_END = ~byte_table(ENDS)
_SIZE = np.uint64(3)
_U = np.uint64


class Proposals:
    """One bit per hash of a proposed phrase, for each phrase length."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.shift = _U(65 - (64 * len(bits[0])).bit_length())

    def has(self, size: int, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return (self.bits[size - 1][slot >> _U(6)] >> (slot & _U(63))) & _U(1) == 1

    def border(self, size: int, parts: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Phrases of a size whose first and last part, with hashes ``parts``, are proposed."""
        if size == 1:
            return np.ones(len(parts), bool)
        known = self.has(size - 1, parts)
        return joined & known[:-1] & known[1:]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(ends):
            full = (ends[first - 1] if first else 0) + STRETCH_BYTES
            n = max(1, int(np.searchsorted(ends, full, "right")) - first)
            yield Stretch(batch["lang"].slice(first, n).to_pylist(), batch["text"].slice(first, n).to_pylist())
            first += n


class Stretch:
    """The words of some texts, their hashes, and which words follow each other in a piece."""

    def __init__(self, langs: list[str], texts: list[str]):
        # A row ends with a piece end, so no phrase runs from text to text.
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        rows = np.cumsum([0, *(len(t) + 1 for t in encoded)])
        data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
        self.inside = np.concatenate([[False], _WORD[data], [False]])
        self.starts = np.flatnonzero(self.inside[1:-1] & ~self.inside[:-2])
        self.ends = np.flatnonzero(self.inside[1:-1] & ~self.inside[2:]) + 1
        self.names = sorted(set(langs))
        ranks = {name: i for i, name in enumerate(self.names)}
        self.lang = np.array([ranks[x] for x in langs], np.int32)[np.searchsorted(rows, self.starts, "right") - 1]
        self.lower = LOWER[data]
        seeds = np.array([_hash(f"{x} ".encode()) for x in self.names], _U)
        self.words = mix(span_hashes(self.lower, self.starts, self.ends) ^ seeds[self.lang])
        piece = np.searchsorted(np.flatnonzero(_END[data]), self.starts)
        self.follows = piece[1:] == piece[:-1]

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per size: hashes at each word, which of them lie in one piece, and the hashes one size below."""
        code, joined = self.words, np.ones(len(self.words), bool)
        for size in range(1, MOST_WORDS + 1):
            parts = code
            if size > 1:
                joined = joined[:-1] & self.follows[size - 2 :]
                code = mix(parts[:-1] * _U(0xC2B2AE3D27D4EB4F) + self.words[size - 1 :])
            if not len(code):
                return
            code = (code & ~_SIZE) | _U(size)
            yield size, code, joined, parts

    def line(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words alone with one blank between them, and the start and length of each."""
        kept = self.inside[1:-1].copy()
        kept[self.ends] = True
        lengths = self.ends - self.starts
        at = np.cumsum(lengths + 1) - lengths - 1
        line = self.lower[kept]
        line[at + lengths] = 32
        return line, at, lengths


def _hash(data: bytes) -> int:
    return int(span_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def _sums(documents: DataFrame, least: int, new: Proposals | None = None, old: Proposals | None = None) -> DataFrame:
    """hash, n of the phrases found ``least`` times or more, among those in the border of ``new``
    and not in that of ``old``; without ``new`` among all. The low bits of a hash are the size."""
    told = documents.sparkSession.sparkContext.broadcast((new, old))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = told.value
        held, rows = [], 0
        for stretch in _stretches(batches):
            for size, code, joined, parts in stretch.phrases():
                wanted = new.border(size, parts, joined) if new else joined
                if old:
                    wanted &= ~old.border(size, parts, joined)
                held.append(np.unique(code[wanted], return_counts=True))
                rows += len(held[-1][0])
            if rows > HELD:
                yield _added_up(held)
                held, rows = [], 0
        if held:
            yield _added_up(held)

    sums = documents.mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    sums = materialize(sums.where(F.col("n") >= least), "phrase-sums")
    told.destroy()
    return sums


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row per hash of the sums of several stretches, each sorted by hash."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, first) if len(first) else n
    return pa.record_batch([pa.array(keys[first].view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])


def _with_bits(proposed: Proposals | None, sums: DataFrame) -> Proposals:
    """Proposals joined by the phrases of ``sums``: at most 2^(FILTER_BITS - 6) rows per size reach the driver."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = (
        sums.select(F.col("hash").bitwiseAND(3).alias("size"), slot.alias("slot"))
        .groupBy("size", F.shiftrightunsigned("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    )
    of, at, new = (words[c].to_numpy() for c in ("size", "word", "bits"))
    out = []
    for size in range(1, MOST_WORDS + 1):
        bits = proposed.bits[size - 1].copy() if proposed else np.zeros(1 << (FILTER_BITS - 6), _U)
        bits[at[of == size]] |= new[of == size].view(_U)
        out.append(bits)
    return Proposals(out)


def _phrases(documents: DataFrame, frequent: Proposals) -> DataFrame:
    """lang, size, phrase, n of the phrases with a bit in ``frequent``, and the number of words as size 0."""
    told = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in _stretches(batches):
            names, lang = stretch.names, stretch.lang
            line, at, lengths = stretch.line()
            words = np.bincount(lang, minlength=len(names))
            yield _batch(names, 0, [""] * len(names), words)
            for size, code, joined, _ in stretch.phrases():
                mine = np.flatnonzero(joined & told.value.has(size, code))
                _, first, n = np.unique(code[mine], return_index=True, return_counts=True)
                first = mine[first]
                for k in range(0, len(first), BATCH):
                    f = first[k : k + BATCH]
                    span = at[f + size - 1] + lengths[f + size - 1] - at[f]
                    offsets = np.concatenate([[0], np.cumsum(span)]).astype(np.int64)
                    source = np.arange(offsets[-1]) + np.repeat(at[f] - offsets[:-1], span)
                    phrase = pa.LargeStringArray.from_buffers(len(f), pa.py_buffer(offsets), pa.py_buffer(line[source]))
                    yield _batch([names[i] for i in lang[f]], size, phrase.cast(pa.string()), n[k : k + BATCH])

    each = documents.mapInArrow(run, "lang string, size int, phrase string, n bigint")
    sums = each.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    sums = materialize(sums.where((F.col("n") >= LEAST_COUNT) | (F.col("size") == 0)), "phrases")
    told.destroy()
    return sums


def _batch(langs: list[str], size: int, phrase: pa.Array | list[str], n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(langs, pa.string()), pa.array(np.full(len(n), size, np.int32)), pa.array(phrase, pa.string()), pa.array(n.astype(np.int64))]
    return pa.record_batch(columns, ["lang", "size", "phrase", "n"])


def frequent_phrases(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, size, phrase, n of all phrases of up to ``MOST_WORDS`` words found ``LEAST_COUNT``
    times; the phrase of size 0 holds the number of all words of the language."""
    texts = documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = texts.where(F.pmod(F.xxhash64("lang", "text"), F.lit(sample)) == 0)
    border = _with_bits(None, _sums(chosen, SAMPLE_COUNT))
    found = _sums(texts, LEAST_COUNT, border)
    while True:
        larger = _with_bits(border, found)
        # The longest phrases are part of no border.
        if all((a == b).all() for a, b in zip(larger.bits[:-1], border.bits[:-1])):
            return _phrases(texts, _with_bits(None, found))
        found = found.unionByName(_sums(texts, LEAST_COUNT, larger, border))
        border = larger


def _cuts(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a and, for each way to cut it, k and its two parts."""
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("left"),
        F.array_join(F.slice(words, k + 1, F.col("size")), " ").alias("right"),
    ))
    return phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.inline(cuts))


def _floor_score(a: Column, l: Column, r: Column) -> Column:
    wide = "decimal(19,0)"
    return F.expr(f"cast((cast(1000000 as decimal(7,0)) * cast({a} as {wide}) * cast({a} as {wide})) div (cast({l} as {wide}) * cast({r} as {wide})) as bigint)")


def collocations(documents: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of every language."""
    found = frequent_phrases(documents)
    counts = found.where(f"size between 1 and {MOST_WORDS - 1}").select("lang", "phrase", F.col("n").alias("f"))
    cuts = _cuts(found)
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    scored = cuts.withColumn("score", _floor_score("a", "l", "r"))
    weakest = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda j: F.transform(
        F.sequence(F.lit(1), F.col("size") - j + 1), lambda i: F.array_join(F.slice(words, i, j), " "))))
    around = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "n")
    around = around.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = weakest.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < LARGER_SHARE * F.col("a"))
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", "part").orderBy(*order)
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = some.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    totals = found.where("size = 0").select("lang", "n")
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
