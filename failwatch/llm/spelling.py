"""Spelling variants: words one edit from a far more frequent one, by a bit-sliced position index.

1. Words are counted with map-side sums; from here on only the vocabulary moves.
2. Two words one edit apart differ inside one part of the shorter one's positions. Every word is
   dealt under keys that leave such a part ``[low, high)`` out: the key is a hash of the shorter
   length, the part and the letters outside it, so words that meet agree outside the part. A
   group of more than ``GROUP_WORDS`` words is dealt again with its part cut in two. Parts of one
   position hold no more words than the alphabet has letters, so no group is unbounded and
   frequent beginnings need no cap.
3. In a task the words of a group stand in lanes of 64, the most frequent first. For each
   (position, letter) and lane a 64-bit set tells which words have that letter there. All words
   ask all lanes of their group at once: four sets per question, words without an error so far,
   and with one letter replaced, left out or put in, go from position to position by
   ``and``/``or`` with the sets of the same, the next and the previous position.
4. A set may leave "no error" only at the first position that differs, and only inside the
   group's part. So each pair is met in exactly one group, in both directions, and the numbers of
   a word are sums over its groups; no pairs are written. The lowest bit is the most frequent.
5. Forms lead from word to more frequent word, so following them ends; the roots come from
   pointer jumping.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty one; repeated
rows count again; words of any length and alphabet take part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from failwatch.llm.common import tasks
from failwatch.storage import materialize

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: How many times as frequent a word's form is, at least.
RATIO = 2
#: Words of a group that are compared in one place.
GROUP_WORDS = 512
#: Rows that a task looks at in one go.
CHUNK_ROWS = 50_000
_U = np.uint64
_NEAR = "word string, n_near bigint, best_n bigint, best string"


def vocabulary(documents: DataFrame, damage: int | None = None) -> DataFrame:
    """word, n: lower-cased runs of letters, long and frequent enough.

    With ``damage``, a run of a document whose crc32 it divides loses one letter, which plants
    known misspellings."""
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("word"),
    )
    if damage:
        h = F.crc32(F.concat("doc", F.lit(":"), "word"))
        # Summed with the place of the letter first: few rows lose one, so only sums are cut.
        runs = runs.select("word", h.alias("h")).select(
            "word", F.when(F.col("h") % damage == 0, F.col("h") % F.length("word")).cast("int").alias("at")
        )
        sums = runs.groupBy("word", "at").agg(F.count(F.lit(1)).alias("n"))
        cut = F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word")))
        counts = sums.groupBy(F.coalesce(cut, "word").alias("word")).agg(F.sum("n").alias("n"))
    else:
        counts = runs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT))


def _dealt(words: DataFrame, parts: Column) -> DataFrame:
    """Rows word, n, m (shorter length), low, high and key, one for each of ``parts``."""
    rows = words.select("word", "n", F.inline(parts)).where("low < high")
    more = F.length("word") - F.col("m")
    outside = [F.substring("word", F.lit(1), F.col("low")), F.substring("word", F.col("high") + more + 1, F.length("word"))]
    return rows.withColumn("key", F.xxhash64("m", "low", "high", *outside))


def _part(m: Column, low: Column, high: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def _groups(words: DataFrame) -> DataFrame:
    """The rows of all groups of two words or more that can be compared in one place."""
    halves = []
    for m in (F.length("word"), F.length("word") - 1):
        half = F.floor(m / 2)
        halves += [_part(m, F.lit(0), half), _part(m, half, m)]
    level, fitting = materialize(_dealt(words, F.array(*halves)), "halves"), []
    while True:
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("size"), (F.max("high") - F.min("low")).alias("width"))
        sizes = materialize(sizes.where("size > 1"), "sizes")
        small = (F.col("size") <= GROUP_WORDS) | (F.col("width") == 1)
        fitting.append(level.join(sizes.where(small).select("key"), "key", "left_semi"))
        large = sizes.where(~small).select("key")
        if large.isEmpty():
            return _union(fitting)
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        cut = F.array(_part(F.col("m"), F.col("low"), middle), _part(F.col("m"), middle, F.col("high")))
        rest = level.join(large, "key", "left_semi").select("word", "n", cut.alias("parts"))
        level = materialize(_dealt(rest, F.col("parts")), "parts")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of the counts, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - firsts, counts)


def near_words(rows: pa.Table) -> pa.RecordBatch:
    """Per word of whole, sorted groups: how many words of its group are near, and the first one."""
    words = rows["word"].combine_chunks()
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    m, low, high, key = (rows[c].to_numpy() for c in ("m", "low", "high", "key"))
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, codes = np.unique(codes, return_inverse=True)
    at = np.cumsum(lengths) - lengths
    count = len(words)

    new = np.ones(count, bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, count))
    lanes = (sizes + 63) // 64
    lane0 = np.cumsum(lanes) - lanes
    place = np.arange(count) - first[group]
    lane = lane0[group] + place // 64
    bit = _U(1) << (place % 64).astype(_U)
    n_lanes = int(lanes.sum())

    def members(mine: np.ndarray) -> np.ndarray:
        out = np.zeros(n_lanes, _U)
        np.bitwise_or.at(out, lane[mine], bit[mine])
        return out

    short, long, everyone = members(lengths == m), members(lengths == m + 1), members(np.ones(count, bool))
    longest_first = np.argsort(-lengths, kind="stable")
    sorted_lengths = -lengths[longest_first]

    def letter_sets(i: int) -> np.ndarray:
        """The words with a letter at position i, at lane * letters + letter."""
        out = np.zeros(n_lanes * len(letters), _U)
        mine = longest_first[: np.searchsorted(sorted_lengths, -i, "left")]
        if i >= 0 and len(mine):
            np.bitwise_or.at(out, lane[mine] * len(letters) + codes[at[mine] + i], bit[mine])
        return out

    asking = np.repeat(np.arange(count), lanes[group])
    asked = _ranges(lane0[group], lanes[group])
    order = np.argsort(-lengths[asking], kind="stable")
    asking, asked = asking[order], asked[order]
    until = -lengths[asking]
    right, one_replaced, one_more, one_less = (np.zeros(len(asking), _U) for _ in range(4))
    right |= everyone[asked]
    before, here, behind = letter_sets(-1), letter_sets(0), letter_sets(1)
    for i in range(int(lengths.max(initial=0))):
        k = int(np.searchsorted(until, -i, "left"))
        who = asking[:k]
        cell = asked[:k] * len(letters) + codes[at[who] + i]
        same, shifted_on, shifted_back = here[cell], behind[cell], before[cell]
        inside = np.minimum(i, m[who] - 1)
        leaving = np.where((low[who] <= inside) & (inside < high[who]), right[:k] & ~same, _U(0))
        one_replaced[:k] = (one_replaced[:k] & same) | leaving
        one_more[:k] = (one_more[:k] | leaving) & shifted_on
        one_less[:k] = (one_less[:k] & shifted_back) | leaving
        right[:k] &= same
        before, here, behind = here, behind, letter_sets(i + 2)
    at_end = np.where(high[asking] == m[asking], right, _U(0))
    found = np.where(
        lengths[asking] == m[asking],
        (one_replaced & short[asked]) | ((one_more | at_end) & long[asked]),
        one_less & short[asked],
    )
    hit = np.flatnonzero(found)
    sets, who = found[hit], asking[hit]
    n_near = np.zeros(count, np.int64)
    np.add.at(n_near, who, np.bitwise_count(sets).astype(np.int64))
    lowest = np.bitwise_count((sets & (~sets + _U(1))) - _U(1)).astype(np.int64)
    best = np.full(count, count)
    np.minimum.at(best, who, first[group[who]] + (asked[hit] - lane0[group[who]]) * 64 + lowest)
    mine = np.flatnonzero(n_near)
    return pa.record_batch(
        [words.take(pa.array(mine)), pa.array(n_near[mine]), rows["n"].combine_chunks().take(pa.array(best[mine])),
         words.take(pa.array(best[mine]))],
        ["word", "n_near", "best_n", "best"],
    )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        key = rows["key"].to_numpy()
        whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if whole:
            yield near_words(rows.slice(0, whole))
        held = rows.slice(whole).to_batches()
    if held:
        yield near_words(pa.Table.from_batches(held))


def near_counts(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best of every word that has near words."""
    groups = _groups(words)
    dealt = groups.repartition(tasks(groups), "key").sortWithinPartitions("m", "key", F.desc("n"), "word")
    found = dealt.select("word", "n", "m", "low", "high", "key").mapInArrow(_compare, _NEAR)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return best.select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every word with a form: the last word that forms lead to."""
    known = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(known.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        known = jumped.select("word", "root")
        if jumped.where("next is not null").isEmpty():
            return known


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of a vocabulary (word, n)."""
    words = materialize(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    near = materialize(near_counts(words), "near")
    has_form = F.col("best_n") >= RATIO * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
    )
    told = materialize(told, "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corrections(documents: DataFrame) -> DataFrame:
    """word, root, n of the words of documents that another spelling stands for."""
    found = variants(vocabulary(documents))
    return found.where("form is not null").select("word", "root", "n")
