"""Language ID with interpolated Kneser-Ney character models in sorted hash arrays.

Text becomes letters in lower case and single gaps; digits, marks and blanks are gaps. An
event is a letter or the gap after a word, its context the up to three letters before it in
the word. Per language the order-4 counts are taken over all training text by Spark; the lower
orders are the continuation counts that follow from them. The model of all languages is, for
each part, one sorted array of n-gram hashes per order with a column of log probabilities per
language. The language of least cross-entropy per event wins.

The counts cover all training documents and none is left out. N-grams are dealt to ``PARTS``
parts by the letter before the event, so the contexts and the lower orders of an n-gram above
the first are in its own part; tasks build the parts and write them to the shared folder. Sent
to the tasks are only the first order (letters times languages) and the sizes of the parts. A
worker scores the distinct n-grams of a chunk part by part and holds ``HELD_CELLS`` cells of parts.

Calibrated rejection: of every language a tenth of the training documents, ``CALIBRATION_ROWS``
at most, is scored by a second model whose counts are those of the first less these documents'
own. Their cross-entropies give the mean and deviation of their language and the sharpness of the
score. A language of fewer than ``OWN_DEVIATION`` such rows gets at least the usual deviation of
the others. One of fewer than ``CALIBRATION_SHARE`` documents can spare none: the first model scores
them, and its mean is at least the usual one; unseen texts in it may be rejected too readily.
``rejected`` marks texts whose cross-entropy is further than ``REJECT_DEVIATIONS`` above the mean
of their language.

Edge cases: a null text or one without a letter gets ``und`` and score 0; a null lang is not
learned from; code points over 0xFFFF are one letter class; a null doc_id is scored and, as its
crc32 is null, neither held out nor learned from. Without training text everything is ``und``.
A repeated row counts as often as it occurs and is predicted each time; of a doc_id that repeats one
text, the least, calibrates. Texts may have any length: long ones are chunks of their own. Ties go
to the language that sorts first. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from failwatch.llm.files import committed, resolve
from failwatch.llm.words import text_chunks
from failwatch.storage import materialize, new_path

ORDER = 4
#: Parts of the model, by the letter before the event.
PARTS = 256
#: Parts that a worker keeps between chunks: n-grams times languages, 4 bytes each.
HELD_CELLS = 64_000_000
#: Rows of each language that calibrate score and rejection, the documents of least hash.
CALIBRATION_ROWS = 1_000
#: One in so many training rows of a language calibrates, up to that bound.
CALIBRATION_SHARE = 10
#: Parts in which the rows of a language are ranked before the least of all are taken.
RANK_PARTS = 64
#: Calibration rows from which a language's deviation is its own alone.
OWN_DEVIATION = 30
REJECT_DEVIATIONS = 6.0
UNKNOWN = "und"
_U = np.uint64
#: An odd factor makes the hash a bijection of the packed n-gram.
_SPREAD = _U(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20
#: Text scored at a time where a worker can not keep all parts and reads them for each chunk.
LARGE_CHUNK_BYTES = 1 << 24


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """For every code point its lower-case letter as 16 bits, 0 for what is no letter."""
    codes = np.zeros(0x110000, np.uint16)
    for point in range(0x10000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            codes[point] = min(ord(low[0]), 0xFFFF)
    codes[0x10000:] = [0xFFFD if chr(p).isalpha() else 0 for p in range(0x10000, 0x110000)]
    return codes


def events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (four 16-bit letters, the last is the event) and each row's first one."""
    text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # Rows start at bytes that are no continuation bytes, so characters can be counted.
    starts = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts)])[offsets]
    if len(text) != chars[-1]:  # malformed bytes: decode row by row
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        chars = np.cumsum([0, *map(len, parts)])
        text = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    rows = len(offsets) - 1
    # One gap after every row keeps the rows apart.
    codes = np.zeros(len(text) + rows, np.uint16)
    places = np.arange(len(text)) + np.repeat(np.arange(rows), np.diff(chars))
    codes[places] = letter_codes()[text]
    bounds = chars + np.arange(rows + 1)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    c = np.concatenate([np.zeros(3, np.uint64), codes[keep].astype(np.uint64)])
    one, two, three = c[2:-1], c[1:-2], c[:-3]
    two = np.where(one == 0, _U(0), two)
    three = np.where(two == 0, _U(0), three)
    return (three << _U(48)) | (two << _U(32)) | (one << _U(16)) | c[3:], kept


def count_ngrams(training: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (lang, text); each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merged(parts):
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out(lang):
            keys, n = held.pop(lang)
            return pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for lang in set(langs.tolist()):
                mine = batch["text"].filter(pa.array(langs == lang))
                parts = [held[lang]] if lang in held else []
                for _, _, data, offsets in text_chunks(mine, 4 * CHUNK_BYTES):
                    grams, _ = events(data, offsets)
                    parts.append(np.unique(grams, return_counts=True))
                if parts:
                    held[lang] = merged(parts)
                if lang in held and len(held[lang][0]) > 2_000_000:
                    yield out(lang)
        for lang in list(held):
            yield out(lang)

    return (
        training.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )


@dataclass
class Tables:
    """Per order k: sorted n-gram hashes with log probabilities, context hashes with back-off."""

    langs: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    floor: np.ndarray


def _mask(order: int) -> np.uint64:
    return _U((1 << (16 * order)) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the wanted keys, 0 where there is none, and whether there is one."""
    at, known = _find(keys, wanted)
    out = np.zeros((len(wanted), values.shape[1]), values.dtype)
    out[known] = values[at[known]]
    return out, known


#: (gram, n) by order: the counts of a language and the continuation counts below them.
Levels = dict[int, tuple[np.ndarray, np.ndarray]]


def _levels(grams: np.ndarray, n: np.ndarray) -> Levels:
    own = {ORDER: (grams, n.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):
        grams, n = np.unique(grams & _mask(order), return_counts=True)
        own[order] = (grams, n.astype(np.float64))
    return own


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)


@dataclass
class Shared:
    """What all parts have in common: discounts by (language, order), first-order counts."""

    langs: list[str]
    discounts: dict[tuple[str, int], float]
    first: dict[str, tuple[np.ndarray, np.ndarray]]


def _totals(levels: Levels) -> dict[tuple[int, int], int]:
    """By (order, key) what is added up over the parts of a language: how many n-grams occur
    once and twice (keys 1 and 2), and the counts of the first order (the letter as key)."""
    found = {(order, k): int((levels[order][1] == k).sum()) for order in range(2, ORDER + 1) for k in (1, 2)}
    return found | {(1, int(g)): int(n) for g, n in zip(*levels[1])}


def _shared(totals: dict[str, dict[tuple[int, int], int]]) -> Shared:
    langs, discounts, first = sorted(totals), {}, {}
    for lang, own in totals.items():
        letters = sorted(k for order, k in own if order == 1)
        first[lang] = np.array(letters, np.uint64), np.array([own[1, k] for k in letters], np.float64)
        n = first[lang][1]
        discounts[lang, 1] = _discount((n == 1).sum(), (n == 2).sum())
        for order in range(2, ORDER + 1):
            discounts[lang, order] = _discount(own[order, 1], own[order, 2])
    return Shared(langs, discounts, first)


def _tables(levels: dict[str, Levels], shared: Shared, least: int = 1) -> Tables:
    """Interpolated tables of the n-grams in ``levels``, from order ``least`` up."""
    langs = shared.langs
    symbols = len(np.unique(np.concatenate([shared.first[x][0] for x in langs])))
    floor = 1.0 / (symbols + 1)
    empty = np.zeros(0, np.uint64), np.zeros(0)
    own = {x: {**levels.get(x, {}), 1: shared.first[x]} for x in langs}
    keys = [np.unique(np.concatenate([own[x].get(order, empty)[0] for x in langs])) for order in range(1, ORDER + 1)]
    contexts = [np.unique(k >> _U(16)) for k in keys]
    of = [np.searchsorted(c, k >> _U(16)) for c, k in zip(contexts, keys)]
    lower = [np.searchsorted(keys[i - 1], keys[i] & _mask(i)) for i in range(1, ORDER)]
    spread = [np.argsort(k * _SPREAD, kind="stable") for k in keys]
    spread_contexts = [np.argsort(c * _SPREAD, kind="stable") for c in contexts]
    logs = [np.zeros((len(k), len(langs)), np.float32) for k in keys]
    backs = [np.zeros((len(c), len(langs)), np.float32) for c in contexts]
    for i, lang in enumerate(langs):
        below = np.full(len(keys[0]), floor)
        for k in range(ORDER):
            grams, n = own[lang].get(k + 1, empty)
            discount = shared.discounts[lang, k + 1]
            mine = np.searchsorted(keys[k], grams)
            total = np.bincount(of[k][mine], n, len(contexts[k]))
            kinds = np.bincount(of[k][mine], minlength=len(contexts[k]))
            seen = total > 0
            back = np.ones(len(contexts[k]))
            back[seen] = discount * kinds[seen] / total[seen]
            p = back[of[k]] * (below if k == 0 else below[lower[k - 1]])
            p[mine] += (n - discount) / total[of[k][mine]]
            logs[k][:, i] = np.log(np.maximum(p[spread[k]], 1e-30))
            backs[k][:, i] = np.log(np.maximum(back[spread_contexts[k]], 1e-30))
            below = p
    grams = [(k * _SPREAD)[o] for k, o in zip(keys, spread)]
    hashes = [(c * _SPREAD)[o] for c, o in zip(contexts, spread_contexts)]
    for k in range(least - 1):
        grams[k], logs[k], hashes[k], backs[k] = empty[0], logs[k][:0], empty[0], backs[k][:0]
    return Tables(langs, grams, logs, hashes, backs, np.full(len(langs), np.log(floor), np.float32))


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Tables:
    """Interpolated Kneser-Ney tables from the order-4 counts (gram, n) per language."""
    levels = {lang: _levels(*rows) for lang, rows in counts.items()}
    return _tables(levels, _shared({lang: _totals(own) for lang, own in levels.items()}))


def log_probs(model: Tables, grams: np.ndarray) -> np.ndarray:
    """Interpolated log probability of every event, a column per language.

    An n-gram that no language has seen backs off; the back-off weights are 1 where a context
    is new to a language."""
    out, known = _rows(model.grams[ORDER - 1], model.logs[ORDER - 1], grams * _SPREAD)
    left = np.flatnonzero(~known)
    if len(left):
        for order in range(ORDER, 1, -1):
            out[left] += _rows(model.contexts[order - 1], model.backs[order - 1], ((grams[left] & _mask(order)) >> _U(16)) * _SPREAD)[0]
            logs, has = _rows(model.grams[order - 2], model.logs[order - 2], (grams[left] & _mask(order - 1)) * _SPREAD)
            out[left] += logs
            left = left[~has]
        out[left] += model.floor
    return out


#: Parts that this worker has read, by file, the latest last.
_held: OrderedDict[str, Tables] = OrderedDict()


@dataclass
class Parts:
    """The model in files: the first order and, by part, the path of the orders above it."""

    first: Tables
    paths: dict[int, str]
    cells: int

    @property
    def langs(self) -> list[str]:
        return self.first.langs

    def part(self, number: int) -> Tables:
        path = self.paths.get(number)
        if path is None:  # no n-gram of this part was learned
            return self.first
        if path not in _held:
            store, file = resolve(path)
            with store.open_input_stream(file) as stream:
                found = np.load(io.BytesIO(stream.read()))
            f = self.first
            arrays = [[own[0], *(found[f"{name}{k}"] for k in range(1, ORDER))] for name, own in (("g", f.grams), ("l", f.logs), ("c", f.contexts), ("b", f.backs))]
            _held[path] = Tables(f.langs, *arrays, f.floor)
            while len(_held) > 1 and sum(x.size for t in _held.values() for x in (*t.logs, *t.backs)) > HELD_CELLS:
                _held.popitem(last=False)
        _held.move_to_end(path)
        return _held[path]

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        number = part_of(grams)
        order = np.argsort(number, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            if len(mine):
                out[mine] = log_probs(self.part(int(number[mine[0]])), grams[mine])
        return out


def part_of(grams: np.ndarray) -> np.ndarray:
    """The part of an n-gram, by the letter before the event."""
    return ((grams >> _U(16)) & _U(PARTS - 1)).astype(np.int64)


def row_entropies(model: Parts, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per event in nats of every row and language, and the number of events."""
    grams, rows = events(data, offsets)
    n = np.diff(rows)
    out = np.zeros((len(n), len(model.langs)))
    full = np.flatnonzero(n)
    if len(full):
        distinct, place = np.unique(grams, return_inverse=True)
        logs = model.log_probs(distinct)
        for i in range(len(model.langs)):
            out[full, i] = -np.add.reduceat(logs[:, i].astype(np.float64)[place], rows[:-1][full]) / n[full]
    return out, n


def _best(model: Parts, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    limit = CHUNK_BYTES if model.cells <= HELD_CELLS else LARGE_CHUNK_BYTES
    for first, end, data, offsets in text_chunks(batch["text"], limit):
        yield first, end, *row_entropies(model, data, offsets)


@dataclass
class Calibration:
    """Mean and deviation of the cross-entropy per language; nats per unit of score."""

    mean: np.ndarray
    deviation: np.ndarray
    scale: float


def _calibrate(languages: list[str], held: pd.DataFrame) -> Calibration:
    """From lang, h (cross-entropy in it), margin (how much more the next best has) and small."""
    means, deviations = np.zeros(len(languages)), np.full(len(languages), 0.02)
    spared = {lang: own["h"].to_numpy() for lang, own in held[~held["small"]].groupby("lang")}
    for i, lang in enumerate(languages):
        if lang in spared:
            # The middle of the distribution: some labels of a corpus are wrong.
            means[i] = np.median(spared[lang])
            deviations[i] = max(np.median(np.abs(spared[lang] - means[i])) * 1.4826, 0.02)
    known = np.array([lang in spared for lang in languages])
    enough = np.array([len(spared.get(lang, ())) >= OWN_DEVIATION for lang in languages])
    usual = [np.median(x[enough if enough.any() else known]) if known.any() else low for x, low in ((means, 0.0), (deviations, 0.02))]
    deviations[~enough] = np.maximum(deviations[~enough], usual[1])
    for lang, own in held[held["small"]].groupby("lang"):
        means[languages.index(lang)] = max(own["h"].median(), usual[0])
    margins = held["margin"][np.isfinite(held["margin"])]
    return Calibration(means, deviations, max(float(margins.abs().median()) / 4, 1e-3) if len(margins) else 1.0)


def _part_levels(table: pa.Table) -> dict[str, Levels]:
    """The levels by language of the (lang, gram, n) rows of a part."""
    langs = table["lang"].combine_chunks().dictionary_encode()
    grams, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    codes = langs.indices.to_numpy()
    order = np.lexsort((grams, codes))
    bounds = np.searchsorted(codes[order], np.arange(len(langs.dictionary) + 1))
    return {lang: _levels(grams[order[a:b]], n[order[a:b]]) for lang, a, b in zip(langs.dictionary.to_pylist(), bounds[:-1], bounds[1:])}


def learn(training: DataFrame) -> Parts | None:
    """The model from (lang, text), all counts in it; None without training text."""
    return build(materialize(count_ngrams(training), "ngrams"))


def build(counts: DataFrame) -> Parts | None:
    """The model of the counts (lang, gram, n), which are read twice; None without any."""
    spark = counts.sparkSession
    counts = counts.withColumn("part", F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(PARTS - 1)).cast("int"))

    def totals(table: pa.Table) -> pa.Table:
        found = [(lang, *key, n) for lang, own in _part_levels(table).items() for key, n in _totals(own).items()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found), kinds)], ["lang", "level", "key", "n"])

    parts = counts.groupBy("part")
    # At most letters times languages: the letters are 16 bits.
    summed = parts.applyInArrow(totals, "lang string, level int, key int, n bigint").groupBy("lang", "level", "key").agg(F.sum("n").alias("n"))
    by_lang: dict[str, dict[tuple[int, int], int]] = {}
    for r in summed.collect():
        by_lang.setdefault(r.lang, {})[r.level, r.key] = r.n
    if not by_lang:
        return None
    shared, folder = _shared(by_lang), new_path(spark, "language-model")
    sent = spark.sparkContext.broadcast(shared)

    def write(table: pa.Table) -> pa.Table:
        model, number = _tables(_part_levels(table), sent.value, least=2), table["part"][0].as_py()
        file = io.BytesIO()
        named = (("g", model.grams), ("l", model.logs), ("c", model.contexts), ("b", model.backs))
        np.savez(file, **{f"{name}{k}": own[k] for name, own in named for k in range(1, ORDER)})
        path = f"{folder}/{number}.npz"
        with committed(path) as out:
            out.write(file.getbuffer())
        cells = sum(x.size for x in (*model.logs, *model.backs))
        return pa.table([pa.array([number], pa.int32()), pa.array([path]), pa.array([cells])], ["part", "path", "cells"])

    built = parts.applyInArrow(write, "part int, path string, cells bigint").collect()
    return Parts(_tables({}, shared), {r.part: r.path for r in built}, sum(r.cells for r in built))


def calibration_texts(training: DataFrame, rows: int) -> DataFrame:
    """doc_id, lang and text of the documents of least hash, a share of each language, ``rows`` at most.

    ``small`` marks those of languages that have fewer than ``CALIBRATION_SHARE`` documents, all of them."""
    least = [F.xxhash64("doc_id"), "doc_id"]
    keys = training.select("doc_id", "lang").withColumn("rank_part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(RANK_PARTS)))
    # Ranked in parts first, so that a language with most rows is not one task's.
    near = keys.withColumn("place", F.row_number().over(Window.partitionBy("lang", "rank_part").orderBy(*least))).where(F.col("place") <= rows)
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*least))).where(F.col("place") <= rows)
    sizes = training.groupBy("lang").agg(F.count("*").alias("rows"))
    small = F.col("rows") < CALIBRATION_SHARE
    sample = ranked.join(sizes, "lang").where(small | (F.col("place") * CALIBRATION_SHARE <= F.col("rows")))
    sample = sample.select("doc_id", "lang", small.alias("small")).distinct()
    return training.select("doc_id", "lang", "text").join(sample, ["doc_id", "lang"]).groupBy("doc_id", "lang", "small").agg(F.min("text").alias("text"))


def _own_entropies(texts: DataFrame, model: Parts | None) -> pd.DataFrame:
    """lang, h, margin and small of the texts that have a letter and whose language is in the model."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value is None:
            return
        column = {lang: i for i, lang in enumerate(sent.value.langs)}
        for batch in batches:
            for first, end, entropy, n in _best(sent.value, batch):
                rows = batch.slice(first, end - first)
                mine = np.array([column.get(lang, -1) for lang in rows["lang"].to_pylist()])
                known = np.flatnonzero((mine >= 0) & (n > 0))
                places, others = np.arange(len(known)), entropy[known]
                h = others[places, mine[known]]
                others[places, mine[known]] = np.inf
                kept = rows.take(pa.array(known))
                yield pa.record_batch([kept["lang"], pa.array(h), pa.array(others.min(axis=1) - h), kept["small"]], ["lang", "h", "margin", "small"])

    return texts.select("lang", "text", "small").mapInArrow(run, "lang string, h double, margin double, small boolean").toPandas()


def train(training: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> tuple[Parts, Calibration] | None:
    """Model and calibration from (doc_id, lang, text); None without training text."""
    counts = materialize(count_ngrams(training), "ngrams")
    model = build(counts)
    if model is None:
        return None
    texts = materialize(calibration_texts(training, calibration_rows), "calibration")
    own = count_ngrams(texts.where("not small")).withColumn("n", -F.col("n"))
    rest = counts.unionByName(own).groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 0")
    unseen = build(materialize(rest, "ngrams-unseen"))
    held = pd.concat([_own_entropies(texts.where("not small"), unseen), _own_entropies(texts.where("small"), model)])
    return model, _calibrate(model.langs, held)


def predict(documents: DataFrame, trained: tuple[Parts, Calibration] | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected for every document."""
    rows = documents.select(F.col("doc_id").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
    if trained is None:
        return rows.select(
            "doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"),
        )
    sent = documents.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, calibration = sent.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            for first, end, entropy, n in _best(model, batch):
                rows = np.arange(end - first)
                best = entropy.argmin(axis=1)
                least = entropy[rows, best]
                odds = np.exp(-np.minimum((entropy - least[:, None]) / calibration.scale, 700))
                empty = n == 0
                far = least > calibration.mean[best] + REJECT_DEVIATIONS * calibration.deviation[best]
                yield pa.record_batch(
                    [
                        batch["doc_id"].slice(first, end - first),
                        batch["held_out"].slice(first, end - first),
                        pa.array(names[np.where(empty, len(model.langs), best)].tolist(), pa.string()),
                        pa.array(np.where(empty, 0.0, 1.0 / odds.sum(axis=1))),
                        pa.array(least, mask=empty),
                        pa.array(far | empty),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    return rows.mapInArrow(run, schema)


def held_out(doc_id: str) -> Column:
    """Whether the document is in the fold that is not learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out fold and predict the language of all."""
    training = documents.where("lang is not null and text is not null and doc_id is not null").where(~held_out("doc_id"))
    return predict(documents, train(training))
