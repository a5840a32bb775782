"""Operators on documents against brute force, and on odd and empty tables."""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from failwatch.llm import decontam, language, line_dedup, near_dedup, packing, simple8b, tokens, toxicity
from failwatch.llm.tokens import UnitTokenizer, tokenizer
from failwatch.llm.words import ALPHANUMERIC, UNSPACED, letter_spans, mix, span_hashes, text_chunks, word_hashes
from failwatch.storage import new_path
from pyspark.sql import functions as F

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# language

def test_language_held_out_accuracy(spark, sf_dir, docs):
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_kneser_ney_sums_to_one():
    data = np.frombuffer("abc abd abe bcd bce the then them".encode(), np.uint8)
    grams, _ = language.events(data, np.array([0, len(data)]))
    keys, n = np.unique(grams, return_counts=True)
    model = language.kneser_ney({"x": (keys, n)})
    letters = np.unique(grams & np.uint64(0xFFFF))
    for context in np.unique(keys >> np.uint64(16)):
        p = np.exp(language.log_probs(model, (context << np.uint64(16)) | letters)[:, 0].astype(float)).sum()
        assert p == pytest.approx(1 - np.exp(model.floor[0]) * language_missing(model, context), abs=1e-4)


def language_missing(model, context):
    """Share of the uniform floor's one unseen letter in a context: the product of back-offs."""
    share = 1.0
    for order in range(4, 0, -1):
        wanted = (context & language._mask(order - 1)) if order > 1 else np.uint64(0)
        at, has = language._find(model.contexts[order - 1], np.array([wanted], np.uint64) * language._SPREAD)
        share *= float(np.exp(model.backs[order - 1][at[0], 0])) if has[0] else 1.0
    return share


def test_language_odd(odd_docs, no_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert language.identify(no_docs).collect() == []
    assert {r.lang_pred for r in language.predict(odd_docs, None).collect()} == {"und"}


def test_language_keeps_every_count(spark, docs, monkeypatch):
    """The model in parts, read part by part, is the one of all counts in one piece."""
    monkeypatch.setattr(language, "HELD_CELLS", 1)
    texts = defaultdict(list)
    for r in docs.collect():
        if r.lang is not None and r.text is not None:
            texts[r.lang].append(r.text)
    counts = {}
    for lang, own in texts.items():
        for _, _, data, offsets in text_chunks(pa.array(own), 1 << 40):
            counts[lang] = np.unique(language.events(data, offsets)[0], return_counts=True)
    whole, parts = language.kneser_ney(counts), language.learn(docs.where("lang is not null and text is not null"))
    known = np.unique(np.concatenate([g for g, _ in counts.values()]))
    unseen = (known << np.uint64(16)) | np.random.default_rng(0).integers(97, 140, len(known)).astype(np.uint64)
    for grams in (known, unseen):
        assert parts.langs == whole.langs
        assert np.abs(parts.log_probs(grams) - language.log_probs(whole, grams)).max() < 1e-5


def plain_kneser_ney(texts):
    """Log probability of a letter after up to three of its word, from dicts; and all letters."""
    counts = [defaultdict(int) for _ in range(5)]
    for text in texts:
        for context, x in plain_events(text):
            counts[4][context, x] += 1
    for k in (3, 2, 1):
        for context, x in counts[k + 1]:
            counts[k][context[1:], x] += 1
    discounts = {}
    for k in range(1, 5):
        once, twice = (sum(n == m for n in counts[k].values()) for m in (1, 2))
        discounts[k] = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
    own = [defaultdict(list) for _ in range(5)]
    for k in range(1, 5):
        for (context, _), n in counts[k].items():
            own[k][context].append(n)

    def p(context, x, k, floor):
        if k == 0:
            return floor
        context = context[len(context) - (k - 1) :]
        below, seen = p(context, x, k - 1, floor), own[k].get(context)
        if not seen:
            return below
        n = counts[k].get((context, x), 0)
        return (max(n - discounts[k], 0) if n else 0) / sum(seen) + discounts[k] * len(seen) / sum(seen) * below

    return p, {x for _, x in counts[1]}


def plain_events(text):
    word = ""
    for char in (text or "") + " ":
        char = char.lower() if char.isalpha() else " "
        if char != " " or word:
            yield ("   " + word)[-3:], char
        word = word + char if char != " " else ""


def test_language_equals_a_plain_model(spark):
    """Predictions and cross-entropies of the query against models of dicts, document by document."""
    rng, rows = random.Random(4), []
    alphabets = {"a": "abcdefgh", "b": "efghijkl", "c": "aeéiouñst"}
    for i in range(400):
        lang = rng.choice("abc")
        words = ["".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 12))]
        rows.append((i, ", ".join(words).title() if i % 3 else " ".join(words), None if i % 17 == 0 else lang))
    found = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    learned = defaultdict(list)
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            learned[lang].append(text)
    models = {lang: plain_kneser_ney(own) for lang, own in sorted(learned.items())}
    floor = 1 / (len(set().union(*(letters for _, letters in models.values()))) + 1)
    texts = {i: text for i, text, _ in rows}
    assert len(found) == len(rows)
    for r in found:
        events = list(plain_events(texts[r.doc_id]))
        if not events:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        h = {lang: -sum(math.log(p(c, x, 4, floor)) for c, x in events) / len(events) for lang, (p, _) in models.items()}
        assert r.cross_entropy == pytest.approx(min(h.values()), abs=1e-5)
        assert h[r.lang_pred] == pytest.approx(min(h.values()), abs=1e-5)


def test_language_rejects_few_texts_of_its_own(spark):
    """Rows that calibrate are not in the counts that score them: unseen texts of small languages stay."""
    rng = random.Random(6)
    def words(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(25))
    alphabets = {"a": "abcdefghij", "b": "ijklmnopqr", "c": "rstuvwxyza"}
    rows = [(i, x, words(alphabets[x])) for i, x in enumerate("a" * 300 + "b" * 120 + "c" * 9)]
    trained = language.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    assert np.isfinite(trained[1].mean).all() and (trained[1].deviation > 0).all()
    asked = [(i, words(alphabets["abc"[i % 3]])) for i in range(150)] + [(900, "жщ " * 40)]
    found = language.predict(spark.createDataFrame(asked, "doc_id bigint, text string"), trained).collect()
    assert [r.rejected for r in found if r.doc_id == 900] == [True]
    for k in (0, 1):
        assert sum(r.rejected for r in found if r.doc_id % 3 == k and r.doc_id < 900) <= 1


def test_calibration_texts_are_the_least_of_each_language(spark):
    rows = [(i, "ab"[i % 10 == 0], f"t{i}") for i in range(500)] + [(7, "b", "again"), (7, "b", "t7")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    ranked = defaultdict(list)
    for r in df.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).collect():
        ranked[r.lang].append((r.h, r.doc_id))
    for bound in (1_000, 3):
        want = {(lang, i) for lang, own in ranked.items() for _, i in sorted(own)[: min(bound, len(own) // language.CALIBRATION_SHARE)]}
        got = [(r.lang, r.doc_id) for r in language.calibration_texts(df, bound).where("not small").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    few = spark.createDataFrame([(1, "z", "y"), (1, "z", "x"), (2, "z", "z")], df.schema)
    got = [(r.doc_id, r.text, r.small) for r in language.calibration_texts(df.union(few), 1_000).where("lang = 'z'").collect()]
    assert sorted(got) == [(1, "x", True), (2, "z", True)]


def test_language_rare_among_many(spark):
    """A hundred languages with counts of eight, and one with counts of one, in over 8 million cells."""
    rng, rows, asked = random.Random(8), [], []
    for k in range(101):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(150)]
        rows += [(len(rows) + i, f"l{k:03}", " ".join(words)) for i in range(1 if k == 50 else 8)]
        asked.append((k, " ".join(rng.sample(words, 20))))
    trained = language.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    assert len(trained[0].langs) == 101
    found = language.predict(spark.createDataFrame(asked, "doc_id bigint, text string"), trained).collect()
    assert all(r.lang_pred == f"l{r.doc_id:03}" for r in found)


def test_language_calibrates_rare_languages(spark, monkeypatch):
    """One row in some hundreds, fewer calibration rows than that: its threshold is not left open."""
    rng = random.Random(9)
    words = {x: ["".join(rng.choice(x) for _ in range(5)) for _ in range(60)] for x in ("abcdefg", "hijklmn", "opqrstu")}
    rows = [(i, x, " ".join(rng.sample(words[x], 20))) for i, x in enumerate(["abcdefg", "hijklmn"] * 200 + ["opqrstu"])]
    trained = language.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), 50)
    rare = trained[0].langs.index("opqrstu")
    assert trained[1].mean[rare] < 5 and trained[1].deviation[rare] >= trained[1].deviation.min()
    asked = [(1, rows[-1][2]), (2, " ".join("".join(rng.choice("opqrstu") for _ in range(9)) + "ыэ" for _ in range(30)))]
    found = {r.doc_id: r for r in language.predict(spark.createDataFrame(asked, "doc_id bigint, text string"), trained).collect()}
    assert [(found[i].lang_pred, found[i].rejected) for i in (1, 2)] == [("opqrstu", False), ("opqrstu", True)]


# decontamination

def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"zz{rng.random()}".replace(".", "")
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"yy{rng.random()}".replace(".", ""))
    return words


def word_edits(a, text):
    """Least edits of item words against any stretch of the text, by the plain table."""
    best = [0] * (len(text) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(best[j] + (x != y), best[j + 1] + 1, new[j] + 1))
        best = new
    return min(best)


def test_decontamination_finds_planted_edits(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rng, rows, truth = random.Random(5), [], {}
    filler = [f"filler{i}" for i in range(400)]
    for item in items.collect():
        words = re.findall(r"\w+", item.text.lower())
        for share in (0, 0.5, 1):
            edits = int(int(decontam.EDIT_RATE * len(words)) * share)
            text = rng.sample(filler, 20) + edited(words, edits, rng) + rng.sample(filler, 20)
            truth[len(rows)] = (item.item_id, share, words, text)
            rows.append((len(rows), ", ".join(text).upper()))
    found = decontam.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    missed = defaultdict(int)
    for doc, (item, share, words, text) in truth.items():
        if (doc, item) not in got:
            missed[share] += 1
    assert missed[0] == missed[0.5] == 0 and missed[1] <= 0.1 * len(truth) / 3
    for (doc, item), r in got.items():
        own, _, words, text = truth[doc]
        if item == own:
            assert word_edits(words, text) <= r.edits <= decontam.EDIT_RATE * len(words)


def plain_words(text):
    """Words character by character: runs of letters, digits and marks; one each in unspaced scripts."""
    words, run = [], ""
    for char in (text or "").lower():
        kind = 0 if unicodedata.category(char)[0] not in "LMN" else 2 if any(a <= ord(char) <= b for a, b in UNSPACED) else 1
        if kind != 1 and run:
            words.append(run)
            run = ""
        if kind == 1:
            run += char
        elif kind == 2:
            words.append(char)
    return [*words, run] if run else words


SCRIPTS = [
    "", None, "Añb—c d’e «f» ", "什么是机器学习，为什么重要？", "日本語テキスト ok漢字x 12年", "ภาษาไทย abc", "e\u0301a 한국어 문장", "😀é", "é", "漢",
    "𠮷野家 x", "a\u00a0b\u3000c", "…", "x", "ñ",
]


def test_words_of_all_scripts():
    for texts in (SCRIPTS, SCRIPTS[::-1], [x for x in SCRIPTS if x], ["ascii only, 1 2", "", "next"]):
        for _, _, data, offsets in text_chunks(pa.array(texts), 1 << 30):
            starts, ends, rows = letter_spans(data, offsets)
            got = [[data[a:b].tobytes().decode().lower() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(rows[:-1], rows[1:])]
            assert got == [plain_words(t) for t in texts]
    broken = np.frombuffer(b"\x80ab\xff\xe4 \xf4\xbf", np.uint8)
    starts, ends, rows = letter_spans(broken, np.array([0, 1, 1, 5, len(broken)]))
    assert (starts < ends).all() and (ends[:-1] <= starts[1:]).all() and rows[-1] == len(starts)


def leaking(docs, items):
    """(doc, item) of all pairs within the bound, each document against each item by the plain table."""
    found = set()
    for doc, text in docs:
        words = plain_words(text)
        for item, own in ((i, plain_words(t)) for i, t in items):
            if len(own) < 2 or len("".join(own).encode()) < decontam.MIN_BYTES:
                continue
            edits = int(decontam.EDIT_RATE * len(own)) if len(own) >= decontam.MIN_WORDS else 0
            if word_edits(own, words) <= edits:
                found.add((doc, item))
    return found


def test_decontamination_is_all_pairs_within_the_bound(spark, sf_dir):
    """All documents with planted items against all items: nothing besides, next to nothing missed."""
    rng = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    for item, text in items:
        words = plain_words(text)
        for share in (0, 0.1, 0.2, 0.3):  # the last is past the bound
            docs.append((1000 + len(docs), " ".join(["before", *edited(words, int(share * len(words)), rng), "after"])))
    want = leaking(docs, items)
    found = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= want and len(want) > 30 and len(want - got) <= 0.05 * len(want)


def test_decontamination_of_short_items_and_unspaced_scripts(spark):
    items = [
        (1, "What is the capital of France?"), (2, "Name three primary colours"), (3, "yes or no"), (4, "internationalisation"),
        (5, "什么是机器学习，为什么它在今天这么重要？"), (6, "请说出三种颜色"), (7, "为什么"), (8, "ภาษาไทยเป็นภาษาที่ใช้ในประเทศไทย"), (9, "what is the CAPITAL of france"),
    ]
    docs = [
        (1, "Quiz: what is the capital of France -- Paris"), (2, "what is the old capital of France"), (3, "name three primary colours" + ", name three primary colours" * 50),
        (4, "yes or no internationalisation 为什么"), (5, "前言。什么是机器学习，为什么他在今天这么重要？后记"), (6, "请说出三种颜色！"), (7, "请说出四种颜色"),
        (8, "x ภาษาไทยเป็นภาษาที่ใช้ในประเทศไทย y"), (9, "what is the"), (10, "capital of France"), (11, "xwhat is the capital of France"), (12, None), (None, "请说出三种颜色"),
        (13, "机器学习今天重要"),
    ]
    found = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(items, "item_id bigint, text string"))
    got = [(r.doc_id, r.item_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == leaking(docs, items)
    assert set(got) == {(1, 1), (1, 9), (3, 2), (5, 5), (6, 6), (8, 8), (None, 6)}


def test_edit_distances_against_table():
    rng = random.Random(1)
    for _ in range(60):
        text, item = [rng.randrange(5) for _ in range(30)], [rng.randrange(5) for _ in range(6)]
        words = np.array(text, np.uint64) + np.uint64(10)
        got = decontam.edit_distances(np.array(item, np.uint64) + np.uint64(10), words, np.arange(30), np.full(30, 30), 3)
        assert min(got) == word_edits(item, text)


def test_decontamination_odd(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "One two three four five six seven eight nine ten eleven twelve."), (2, None), (3, ""), (4, "ok"), (None, "x " * 9)],
        "item_id bigint, text string",
    )
    found = decontam.contamination(odd_docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in found) == [(0, 1, 0), (1, 1, 0), (2, 1, 0), (2, 1, 0)]
    assert decontam.contamination(no_docs, items).collect() == []
    assert decontam.contamination(odd_docs, items.limit(0)).collect() == []
    kept = decontam.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (1, 2)").isEmpty()


# tokens, token files and packing

TEXTS = [
    "", None, "a  b\n\nc", "x  y 　z", " lead", "trail  ", "it's don't 'S", "a.b,c U.S.A. é.z a.́b",
    "<|endoftext|> x<|endoftext|>", "naïve\x1c d \x85 e", "日本語 テキスト", "😀 👍🏽  z", "!! ?? ...\n  -- 12 3 4a",
]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_unit_tokenizer_equals_the_library(path, docs):
    texts = TEXTS + [t for _, t in pairs(docs)]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    units = UnitTokenizer(path)
    for first, end, data, offsets in text_chunks(pa.array(texts)):
        ids, rows = units.encode(data, offsets)
        for i in range(first, end):
            assert ids[rows[i - first] : rows[i - first + 1]].tolist() == want[i]


SPECIAL = [
    "x <|endoftext|> y", "a<|endoftext|>b.<|endoftext|>,c", "  <|startoftext|>  x\n<|endoftext|>\n\n", "<|endoftext|", "<|ENDOFTEXT|> <|endoftext|>\u0338 é\u00a0<|endoftext|>",
]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_those_of_the_plain_call(path):
    plain, texts = Tokenizer.from_file(path), TEXTS + SPECIAL
    ends = {plain.token_to_id("<|endoftext|>"), plain.token_to_id("<|startoftext|>")}
    for first, end, data, offsets in text_chunks(pa.array(texts)):
        ids, rows = tokenizer(path).encode(data, offsets)
        for i in range(first, end):
            want = plain.encode(texts[i] or "", add_special_tokens=False).ids
            assert ids[rows[i - first] : rows[i - first + 1]].tolist() == want
            assert bool(ends & set(want)) == ("<|endoftext|>" in (texts[i] or ""))


PIECES = [
    *"aEsTDhJ", "ß", "ü", "É", "ñ", "\u00d7", "\u00f7", "\u01c5", "\u0130", "\u03a3", "\u0416", "\u047f", "\u0331", "\u030c", "\u0307", "日",
    *".,#$%*'`-_|<>/0 7\n\t", "  ", "\u00a0", "\u0085", "\u2028", "\x1c", "'s", "'LL", "\u212a", "\u00b2", "\U0001f600", "the", "THE",
]


@pytest.mark.parametrize("kept", [40, 100_000])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_of_random_texts(path, kept, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_UNITS", kept)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(PIECES, rng.integers(0, 40))) for _ in range(4000)]
    plain, units = Tokenizer.from_file(path), UnitTokenizer(path, special_as_text=False)
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for first, end, data, offsets in text_chunks(pa.array(texts), 500):
        ids, rows = units.encode(data, offsets)
        for i in range(first, end):
            assert ids[rows[i - first] : rows[i - first + 1]].tolist() == want[i], texts[i]


def test_files_of_one_repeated_doc_id(spark):
    texts = [f"{i % 50} text {i}" for i in range(400)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, "b"), (1, "a")], "doc_id bigint, text string").repartition(4)
    files = simple8b.write_tokens(df, new_path(spark, "t"), WORD)
    assert sum(docs > 0 for _, docs, _ in files) > 1
    rows = [(None, t) for t in sorted(texts)] + [(1, "a"), (1, "b")]
    got = simple8b.read_tokens(spark, files).orderBy("start").collect()
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == list(zip([d for d, _ in rows], encoded(WORD, [t for _, t in rows])))


def test_files_and_packs_hold_ids_of_the_plain_call(spark):
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id bigint, text string")
    files = simple8b.read_tokens(spark, simple8b.write_tokens(df, new_path(spark, "t"), WORD)).collect()
    for path, rows in ((WORD, files), (BYTE, packing.pack(df, BYTE).collect())):
        plain = Tokenizer.from_file(path)
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows}
        assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(SPECIAL)}


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    wide = rng.integers(0, 2**63, 30_000, dtype=np.uint64) >> rng.integers(0, 63, 30_000).astype(np.uint64)
    edge = np.array([2**60, 2**60 - 1, 2**64 - 1, 0, 1] * 700, np.uint64)
    for ids in (np.zeros(0, np.uint64), np.zeros(5000, np.uint64), rng.integers(0, 50_000, 10_001).astype(np.uint64), wide, edge):
        words, offsets = simple8b.encode(ids)
        assert (simple8b.decode(words, offsets, len(ids)) == ids).all()
        if len(ids) > 2 * simple8b.BLOCK:  # a block alone
            one = simple8b.decode(words[offsets[1] : offsets[2]], np.array([0]), simple8b.BLOCK)
            assert (one == ids[simple8b.BLOCK : 2 * simple8b.BLOCK]).all()


def encoded(path, texts):
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    return [[*e.ids, 1] for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark, odd_docs, no_docs, docs):
    for df in (odd_docs, docs):
        files = simple8b.write_tokens(df, new_path(spark, "t"), WORD)
        got = simple8b.read_tokens(spark, files).orderBy("start").collect()
        rows = sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        at = 0
        for r, (doc_id, _), ids in zip(got, rows, encoded(WORD, [t for _, t in rows]), strict=True):
            assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (doc_id, at, ids)
            at += len(ids)
    assert simple8b.read_tokens(spark, simple8b.write_tokens(no_docs, new_path(spark, "t"), WORD)).collect() == []


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_packing_holds_every_id_once(request, which):
    df = request.getfixturevalue(which)
    rows = pairs(df)
    want = sorted((i is None, i or 0, ids) for (i, _), ids in zip(rows, encoded(BYTE, [t for _, t in rows])))
    pieces = packing.pack(df, BYTE).collect()
    sequences = defaultdict(list)
    docs = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append((p.doc_tokens, p.start, ids))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(sum(n for _, n in parts) < 2048 for parts in sequences.values()) <= 1
    for doc_id in {i for i, _ in rows}:
        total = sum(len(ids) for _, _, ids in docs[doc_id])
        assert total == sum(len(ids) for none, i, ids in want if (None if none else i) == doc_id)
        if sum(i == doc_id for i, _ in rows) == 1:
            joined = [t for _, _, ids in sorted(docs[doc_id]) for t in ids]
            assert joined == next(ids for none, i, ids in want if (None if none else i) == doc_id)


def test_least_squares_uses_no_length_too_often():
    histogram = {100: 50, 1948: 40, 1024: 7, 500: 30, 600: 20, 948: 20, 3: 1}
    used = packing.solve(histogram)
    spent = defaultdict(int)
    for combo, n in used:
        assert sum(combo) == packing.CAPACITY
        for length in combo:
            spent[length] += n
    assert all(spent[k] <= histogram[k] for k in spent) and sum(n for _, n in used) >= 60


# near duplicates

def brute_components(rows, words, percent):
    sets, parent = {}, {}
    for doc_id, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        shingles = {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()
        sets[doc_id], parent[doc_id] = shingles, doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def check_components(df, words, similarity):
    want = brute_components([r for r in pairs(df) if r[0] is not None], words, round(100 * similarity))
    for r in near_dedup.near_duplicates(df, words, similarity).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id][1])


def test_near_duplicates(docs, odd_docs, no_docs):
    check_components(docs, 3, 0.85)
    check_components(docs, 5, 0.8)
    check_components(odd_docs, 3, 0.85)
    assert near_dedup.near_duplicates(no_docs).collect() == []
    kept = near_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 2").isEmpty()


def test_near_duplicates_of_large_groups_in_small_blocks(spark, monkeypatch):
    """Chains, near misses and a group of many blocks: no link between different texts is lost."""
    rng = random.Random(3)
    base = [f"t{rng.randrange(5000)}" for _ in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            base[rng.randrange(60)] = f"m{i}"
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "STREAM", 16)
    check_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 0.85)


def test_register_estimate():
    rng = np.random.default_rng(2)
    both = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    sets = [np.unique(both[:4000]), np.unique(both[1000:5000])]
    offsets = np.cumsum([0, *map(len, sets)])
    regs = near_dedup.sketch_sets(np.concatenate(sets), offsets, 600)
    assert near_dedup.estimate(regs[:1], regs[1], 4000, np.array([4000]))[0] == pytest.approx(0.6, abs=0.07)


# lines

def brute_lines(rows):
    """Lines that stay, per row in order, by comparing each with all earlier ones."""
    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < line_dedup.MIN_WORDS or abs(len(a) - len(b)) > 1:
            return False
        at = 0
        while at < min(len(a), len(b)) and a[at] == b[at]:
            at += 1
        if len(a) == len(b):
            return a[at + 1 :] == b[at + 1 :]
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return a[at + 1 :] == b[at:]

    seen, out = defaultdict(set), {}
    for doc_id, text in rows:
        kept = []
        for line in text.split("\n"):
            words = tuple(w for w in line.split(" ") if w)
            n = len(words)
            if words and (words in seen[n] or any(near(words, o) for m in (n - 1, n, n + 1) for o in (seen[m] if n >= line_dedup.MIN_WORDS - 1 else ()))):
                continue
            kept.append(line)
            if words:
                seen[n].add(words)
        # Dropped lines count as earlier ones, too.
        for line in text.split("\n"):
            words = tuple(w for w in line.split(" ") if w)
            if words:
                seen[len(words)].add(words)
        out[doc_id] = kept, len(text.split("\n"))
    return out


@pytest.mark.parametrize("array_words", [4096, 12])
def test_lines(spark, docs, monkeypatch, array_words):
    monkeypatch.setattr(line_dedup, "ARRAY_WORDS", array_words)
    rng = random.Random(4)
    rows = sorted(pairs(docs))[:120]
    for i in range(60):
        line = rng.choice(rng.choice(rows)[1].split("\n")).split(" ")
        rows.append((1000 + i, " ".join(edited(line, rng.randrange(3), rng)) + f"\nown line {i}"))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for doc_id, (kept, n) in brute_lines(rows).items():
        if len(kept) < n and not "".join(kept).strip():
            assert doc_id not in got
        else:
            assert got[doc_id].text == "\n".join(kept) and got[doc_id].n_dropped == n - len(kept)


def test_lines_odd(odd_docs, no_docs):
    kept = line_dedup.clean_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    # The null id comes first, so its line of thirteen words stands for those of twelve.
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [3, 4, 5, 6, 8, 9]
    assert kept.where("doc_id is null").count() == 2
    assert line_dedup.clean_documents(no_docs).collect() == line_dedup.line_report(no_docs).collect() == []


# toxicity

def test_toxicity_on_held_out_rows(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    found = toxicity.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    caught = [r.p_toxic >= toxicity.THRESHOLD for r in found if r.toxic]
    wrong = [r.p_toxic >= toxicity.THRESHOLD for r in found if not r.toxic]
    assert sum(caught) >= 0.6 * len(caught) and sum(wrong) <= 0.05 * len(wrong)


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 4))
    grades = np.clip(x[:, 0] + x[:, 1], 0, 2)
    rows, cols = np.nonzero(x)
    w, cuts = toxicity.fit_cumulative(rows, cols, grades, 4)
    assert cuts[0] < cuts[1] and min(w[:2]) > 5 * max(abs(w[2:]))
    severity, _ = toxicity.Model(np.arange(4, dtype=np.uint64), w, cuts).severity(x @ w)
    assert np.abs(severity - grades).max() < 0.5


def plain_keys(text):
    """Hashes of the words of a text and of their starts, one word at a time."""
    keys = set()
    for word in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode()):
        word = word.lower()
        for size in [0, *(n for n in toxicity.STEMS if n < len(word))]:
            data = np.frombuffer(word[: size or len(word)], np.uint8)
            key = span_hashes(data, np.array([0]), np.array([len(data)]))
            keys.add(int((mix(key ^ toxicity._STEM_SALT) if size else key)[0]))
    return keys


def test_toxicity_of_few_labels(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    assert 0 < len(model.keys) <= toxicity.FEATURES
    found = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
    for doc_id, text in pairs(docs):  # each document by itself
        score = sum(weights.get(k, 0.0) for k in plain_keys(text))
        above = [1 / (1 + math.exp(min(40, max(-40, t - score)))) for t in model.thresholds]
        row = found[doc_id]
        assert row.p_toxic == pytest.approx(above[0], abs=1e-9) and row.severity == pytest.approx(sum(above), abs=1e-9)
        assert row.toxic == (row.p_toxic >= toxicity.THRESHOLD)
    marked = [(found[r.doc_id].toxic, r.toxic) for r in labels.where("toxic is not null").collect() if r.doc_id in found]
    assert sum(t for t, bad in marked if bad) * 2 > sum(bad > 0 for _, bad in marked)
    assert not any(t for t, bad in marked if not bad)
    # One toxic text among clean ones is known again, in a clean document's company, too.
    few = spark.createDataFrame([(i, f"fine words number {i} here") for i in range(30)] + [(30, "grawl snibbet here"), (31, "a grawl snibbet")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i == 30)) for i in range(31)], "doc_id long, toxic int")
    assert [r.doc_id for r in toxicity.classify(few, marks).where("toxic").orderBy("doc_id").collect()] == [30, 31]


def test_cumulative_fit_is_the_best_of_a_dense_model():
    rng = np.random.default_rng(8)
    x = rng.random((300, 5)) < 0.3
    grades = np.digitize(x @ [3.0, 2.0, 1.0, 0.0, -1.0] + rng.logistic(size=300), [2.0, 4.0])
    w, cuts = toxicity.fit_cumulative(*np.nonzero(x), grades, 5, ridge=1.0)

    def loss(w, cuts):
        above = [np.ones(300), *(1 / (1 + np.exp(t - x @ w)) for t in cuts), np.zeros(300)]
        return -sum(np.log(above[g][i] - above[g + 1][i]) for i, g in enumerate(grades)) + 0.5 * (w**2).sum()

    best = loss(w, cuts)
    for i in range(7):
        for step in (-0.02, 0.02):
            move = np.zeros(7)
            move[i] = step
            assert loss(w + move[:5], cuts + move[5:]) > best


def test_toxicity_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (77, 0, 1), (None, 0, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.classify(odd_docs, labels).count() == odd_docs.count()
    kept = toxicity.drop_toxic(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.classify(no_docs, labels).collect() == []


# pipeline

def test_pipeline(spark, sf_dir, docs, odd_docs, no_docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert labels.count() and corpus_pipeline.ORACLE_SQL is None
    for df in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, sf_dir).columns == df.columns
    pieces = corpus_pipeline.run(spark, sf_dir)
    left = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert 0 < len(left) < docs.count()
