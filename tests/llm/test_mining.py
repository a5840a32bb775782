"""Spelling variants, phrases and secrets against plain Python, on odd and on empty tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from failwatch.llm import catalog, oracles, phrases, secrets, spelling
from tests.oracle import connect, difference

LOWERED = str.maketrans(spelling.UPPER, spelling.LOWER)


@pytest.mark.parametrize("key", ["op11_spelling", "op12_phrases", "op13_secrets"])
def test_equals_sql(spark, sf_dir, key):
    entry = SimpleNamespace(query=catalog.QUERIES[key], sql=oracles.ORACLE_SQL[key])
    assert difference(spark, connect(sf_dir), sf_dir, entry) is None


def test_native_plan(docs):
    plan = secrets.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hashes_are_added_up_over_stretches(spark, monkeypatch):
    """Each stretch of text sent its own sums, and most phrases come up in many stretches."""
    monkeypatch.setattr(phrases, "STRETCH_BYTES", 40)
    texts = spark.createDataFrame([("en", "a b c a b")] * 50 + [("de", "a b")] * 7, "lang string, text string").coalesce(1)
    for held in (0, 10, 10**6):
        monkeypatch.setattr(phrases, "HELD", held)
        sums = sorted(r["n"] for r in phrases._sums(texts, 1).collect())
        # In "en" a, b, c, a b, b c, c a, a b c, b c a, c a b; in "de" a, b, a b.
        assert sums == sorted([100, 100, 50, 100, 50, 50, 50, 50, 50, 7, 7, 7])
    parts = [phrases.np.unique(phrases.np.array(x, "u8"), return_counts=True) for x in ([3, 1, 3], [], [3, 2], [1])]
    assert phrases._added_up(parts).to_pydict() == {"hash": [1, 2, 3], "n": [2, 1, 3]}
    assert phrases._added_up(parts[1:2]).num_rows == 0


# spelling

def plain_variants(n: dict[str, int]) -> dict[str, tuple]:
    near, without = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            without[i, rest].add(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for group in without.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def told(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("limit", [4, 64, 512])
def test_variants(spark, monkeypatch, limit):
    """Dense words of few letters, so that groups are large, chains long and edits ambiguous."""
    monkeypatch.setattr(spelling, "GROUP_WORDS", limit)
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(900)}
    words |= {"x" * 70 + y for y in ("", "x", "y", "xy", "yx")} | {"日本語", "日本", "日語", "😀😀", "😀"}
    n = {w: rng.choice([1, 2, 3, 5, 9, 40, 400]) for w in sorted(words)}
    found = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint"))
    assert told(found) == plain_variants(n)


def test_hot_beginning_is_split(spark):
    """Two thirds of the words share their first half: they are dealt anew, and none is lost."""
    rng = random.Random(5)
    n = {"common" + "".join(rng.choice("abcdefgh") for _ in range(6)): rng.randint(1, 99) for _ in range(3000)}
    n |= {"".join(rng.choice("abcdefgh") for _ in range(8)): rng.randint(1, 99) for _ in range(1500)}
    words = spark.createDataFrame(list(n.items()), "word string, n bigint")
    sizes = spelling._groups(words).groupBy("key").count()
    assert sizes.agg({"count": "max"}).first()[0] <= spelling.GROUP_WORDS
    assert told(spelling.variants(words)) == plain_variants(n)


def test_spelling_odd(odd_docs, no_docs):
    rows = told(spelling.variants(spelling.vocabulary(odd_docs, damage=97)))
    assert rows["three"][2] == 4 and all(len(w) >= 5 and r[2] >= 3 for w, r in rows.items())
    assert spelling.variants(spelling.vocabulary(no_docs, damage=97)).collect() == []
    assert spelling.corrections(no_docs).collect() == []


# phrases

def plain_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWERED)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[(lang, *w[i : i + k])] += 1
    return f, n


def plain_collocations(rows, top):
    f, n = plain_counts(rows)
    candidates = {p: a for p, a in f.items() if a >= 10 and len(p) > 2}
    out = defaultdict(list)
    for p, a in candidates.items():
        if len(p) == 3 and any(100 * b >= 50 * a and p[0] == q[0] and p[1:] in (q[1:3], q[2:]) for q, b in candidates.items() if len(q) == 4):
            continue
        parts = [(f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        score, _, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(parts))
        out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, all_ in out.items() for i, (s, a, p, l, r) in enumerate(sorted(all_)[:top])
    )


def prose(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "日本", "x\x1cy", "É", "THE"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", " - "]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words[: 8 + i % 38]) + rng.choice(marks) for _ in range(rng.randint(0, 30)))
        rows.append((i, rng.choice(["en", "de", None]), text if i % 50 else None))
    return rows


@pytest.mark.parametrize("sample", [1, 3, 100_000])
def test_collocations(spark, sample, monkeypatch):
    """A sample of all, of some and of nearly no documents gives the same phrases."""
    rows = prose(1)
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(3)
    whole = phrases.frequent_phrases
    monkeypatch.setattr(phrases, "frequent_phrases", lambda d: whole(d, sample))
    found = sorted(tuple(r) for r in phrases.collocations(df, top=60).collect())
    assert found == plain_collocations([r[1:] for r in rows], 60)


def test_stretches():
    """Rows are dealt to stretches whole, and words of two rows never follow each other."""
    batch = pa.record_batch([["en"] * 5, ["a b", "", "c" * 3_000_000, "d", "e f"]], ["lang", "text"])
    found = list(phrases._stretches(iter([batch])))
    assert [len(s.words) for s in found] == [2, 1, 3] and [s.follows.tolist() for s in found] == [[True], [], [False, True]]


def test_collocations_full_filter(spark, monkeypatch):
    """Bit sets that are all but full count more and change nothing."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 6)
    rows = prose(2)
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == plain_collocations([r[1:] for r in rows], 2000)


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000
    row = spark.createDataFrame([(big, big, big + 1)], "a bigint, l bigint, r bigint")
    assert row.select(phrases._floor_score("a", "l", "r")).first()[0] == 1_000_000 * big * big // (big * (big + 1))


def test_phrases_odd(odd_docs, no_docs):
    rows = phrases.collocations(odd_docs.unionByName(odd_docs).unionByName(odd_docs).unionByName(odd_docs)).collect()
    assert {r.phrase for r in rows if r.phrase.startswith("one")} == {"one two three"}
    assert phrases.collocations(no_docs).collect() == []


# secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def test_base_spans(spark):
    """Random texts of the patterns' own parts, with characters beyond the basic plane between them."""
    rng = random.Random(7)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "ſecret", "toKen", "'", '"', " ", "=", ":", "abc", "abcdef",
             "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef", "deadbeef" * 3, "😀", "é", "\n", "x=", "==", "Q"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))), f"s{i % 3}") for i in range(500)]
    found = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    for i, text, _ in rows:
        base = plain_base(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert [found[i].n_assign, found[i].n_access, found[i].n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        spans = found[i].spans.split(",")
        assert [s for s in spans if s and not s.startswith("live")] == base


def test_ownership(spark):
    """A run of many owners is an example, one of a single owner is reported, base spans stay."""
    copied, own = "Xy7" * 8, "Zq9k" * 6
    rows = [(i, f"see {copied} here", f"o{i % 50}") for i in range(300)] + [(1000 + i, f"see {own} here", "o1") for i in range(100)]
    rows += [(2000, f"token={own}", "o1"), (2001, "token=placeholder", "o2"), (2002, "token=placeholder", "o3"), (2003, "token=placeholder", "o4")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert {found[i].spans for i in range(300)} == {""}
    assert {found[1000 + i].spans for i in range(100)} == {"live:4:28"}
    assert (found[2000].spans, found[2000].n_live) == ("assign:0:30", 1)
    assert (found[2001].spans, found[2001].n_live) == ("assign:0:17", 0)
    spans = {r.value_hash: (r.n_repos, r.n_owners) for r in secrets.secret_spans(df).collect()}
    assert spans[hashlib.sha256(own.encode()).hexdigest()] == (101, 1)
    assert spans[hashlib.sha256(b"placeholder").hexdigest()] == (3, 3)


def test_secrets_odd(spark, odd_docs, no_docs):
    extra = odd_docs.withColumn("text", F.concat("text", F.lit(" token=abcdefgh"))).withColumn("start", odd_docs.key).withColumn("span", odd_docs.key)
    rows = secrets.scan(extra).collect()
    assert len(rows) == extra.count() and sum(r.n_assign for r in rows) == extra.where("text is not null").count()
    assert {r.spans for r in secrets.scan(odd_docs).collect()} == {""}
    assert secrets.scan(no_docs).collect() == []
