"""Distributed mining against one pass in order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from failwatch.operators import templates
from failwatch.settings import Settings
from tests.fixtures import T0, rows_to_df

WILD = "<*>"


def sequential(messages: list[str], max_children: int = 100, threshold: float = 0.4):
    """One pass over all messages with a prefix tree kept in plain dictionaries."""
    firsts: dict[int, list[str]] = {}
    leaves: dict[tuple, list[int]] = {}
    clusters: list[list[str]] = []
    out = []
    for m in messages:
        tokens = m.split()
        first = tokens[0] if tokens else ""
        if any(c.isdigit() for c in first):
            first = WILD
        else:
            known = firsts.setdefault(len(tokens), [])
            if first not in known:
                if len(known) < max_children - 1:
                    known.append(first)
                else:
                    first = WILD
        ids = leaves.setdefault((len(tokens), first), [])
        scored = []
        for place, i in enumerate(ids):
            same = sum(a == b != WILD for a, b in zip(clusters[i], tokens))
            sim = same / len(tokens) if tokens else 1.0
            if sim >= threshold:
                scored.append((-sim, -clusters[i].count(WILD), place, i))
        if scored:
            i = min(scored)[3]
            clusters[i] = [a if a == b else WILD for a, b in zip(clusters[i], tokens)]
        else:
            i = len(clusters)
            clusters.append(tokens)
            ids.append(i)
        out.append((i + 1, " ".join(clusters[i])))
    return out, [" ".join(c) for c in clusters]


def random_messages(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    verbs = ["get", "put", "drop", "scan", "lock"]
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4:  # one busy leaf
            out.append(f"hot {rng.choice(verbs)} {rng.choice(words)} item {rng.randrange(50)} done")
        elif kind < 0.6:
            out.append(f"hot {rng.choice(words)} {rng.choice(words)} {rng.choice(words)} {rng.choice(words)} {i}")
        elif kind < 0.8:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))))
        elif kind < 0.9:
            out.append(f"{rng.randrange(9)}x {rng.choice(verbs)} {rng.choice(words)}")
        else:
            out.append(rng.choice(["", "solo", f"code {rng.choice([200, 200, 404])}"]))
    return out


def mined(spark, messages, **kw):
    rows = [{"ts_us": T0 + i // 3, "log_message": m} for i, m in enumerate(messages)]
    df = templates.mine_templates(rows_to_df(spark, rows).repartition(5), **kw)
    return [(r["template_id"], r["log_template"]) for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_pass(spark, seed):
    messages = random_messages(800, seed)
    assert mined(spark, messages) == sequential(messages)[0]


def test_final_templates(spark):
    messages = random_messages(300, 3)
    rows, clusters = sequential(messages)
    assert mined(spark, messages, final=True) == [(i, clusters[i - 1]) for i, _ in rows]


def test_first_token_limit(spark):
    rng = random.Random(4)
    messages = [f"w{chr(97 + rng.randrange(26))} same tail here" for _ in range(200)]
    got = mined(spark, messages, settings=Settings(max_children=6))
    assert got == sequential(messages, max_children=6)[0]


@pytest.mark.parametrize("rounds,limit", [(1, 1 << 20), (10, 0)])
def test_pass_in_order_gives_the_same(spark, monkeypatch, rounds, limit):
    """Leaves that do not settle, and models that are too large."""
    monkeypatch.setattr(templates, "MAX_ROUNDS", rounds)
    monkeypatch.setattr(templates, "MODEL_LIMIT_BYTES", limit)
    monkeypatch.setattr(templates, "SEED_BUCKETS", 1)
    messages = random_messages(300, 5)
    assert mined(spark, messages) == sequential(messages)[0]


def test_catalogue_continues(spark):
    messages = random_messages(400, 6)
    rows = [{"ts_us": T0 + i, "log_message": m} for i, m in enumerate(messages)]
    df = rows_to_df(spark, rows)
    first = templates.mine_templates(df.where("seq < 250"))
    model = templates.template_catalogue(first)
    second = templates.mine_templates(df.where("seq >= 250"), catalogue=model)
    both = first.unionByName(second).orderBy("seq").collect()
    assert [(r["template_id"], r["log_template"]) for r in both] == sequential(messages)[0]


def test_catalogue_columns(spark):
    rows = [{"ts_us": T0 + i, "log_message": f"job {i} done"} for i in range(3)]
    row = templates.template_catalogue(templates.mine_templates(rows_to_df(spark, rows))).first()
    assert (row["template"], row["tokens"], row["first_seq"], row["n"]) == ("job <*> done", ["job", "<*>", "done"], 0, 3)


def test_matching_does_not_shuffle(spark):
    rows = [{"ts_us": T0 + i, "log_message": f"job {i} done"} for i in range(3)]
    leafed = templates.with_leaf(rows_to_df(spark, rows))
    from failwatch.storage import materialize

    timeline = templates.Timeline({}, [("3 job", 0, T0, 0, "job <*> done")], 0.4)
    plan = templates._matched(materialize(leafed), timeline, False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert leafed.where(F.col("leaf") == "3 job").count() == 3


def test_unicode_blanks_belong_to_tokens(spark):
    got = mined(spark, ["alpha beta gamma omega", "alpha beta delta omega"])
    assert got == [(1, "alpha beta gamma omega"), (1, f"alpha {WILD} omega")]


def test_a_large_catalogue_continues(spark, monkeypatch):
    messages = random_messages(400, 7)
    rows = [{"ts_us": T0 + i, "log_message": m} for i, m in enumerate(messages)]
    df = rows_to_df(spark, rows)
    first = templates.mine_templates(df.where("seq < 250"))
    model = templates.template_catalogue(first)
    monkeypatch.setattr(templates, "MODEL_LIMIT_BYTES", 0)
    second = templates.mine_templates(df.where("seq >= 250"), catalogue=model)
    both = first.unionByName(second).orderBy("seq").collect()
    assert [(r["template_id"], r["log_template"]) for r in both] == sequential(messages)[0]


def test_rows_are_matched_once_and_not_moved(spark):
    rows = [{"ts_us": T0 + i, "log_message": f"job {i} done"} for i in range(50)]
    plan = templates.mine_templates(rows_to_df(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan


def test_many_templates_are_compared_at_once(monkeypatch):
    """a message was compared with the templates of its leaf one by one in Python."""
    rng = random.Random(4)
    words = ["a", "b", "c", "d", templates.WILDCARD]
    for similarity, width in ((0.4, 5), (0.7, 6), (0.0, 3), (1.1, 3), (0.5, 1)):
        messages = [[rng.choice(words) for _ in range(width)] for _ in range(200)]
        fast, plain = templates.Leaf([], similarity), templates.Leaf([], similarity)
        for message in messages:
            got = fast.absorb(message)
            with monkeypatch.context() as only:
                only.setattr(templates, "PLAIN_TEMPLATES", 10**9)
                assert got == plain.absorb(message)
        assert fast.templates == plain.templates
        assert fast._table is not None or len(fast.templates) <= templates.PLAIN_TEMPLATES
    odd = templates.Leaf([["a", "b"]] * 9 + [["a"]])
    assert [odd.match(["a", "b"]) for _ in range(4)] == [0] * 4
