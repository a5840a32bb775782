"""Neighbours, chat and WARC against brute force, on odd and empty tables, and the contract."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

import __spark_entry__ as contract
from failwatch.llm import chat, neighbours, warc
from failwatch.llm.files import listed, resolve
from failwatch.llm.catalog import ORACLE_SQL
from failwatch.storage import new_path
from tests.oracle import connect, difference


def test_neighbours_recall(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vectors.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    index = neighbours.build_index(vectors, 20, shard_rows=128)
    found = defaultdict(list)
    for r in neighbours.search(index, vectors.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        own = found[ids[q]]
        assert [k for k, _, _ in own] == list(range(1, 21))
        hits += len({ids[i] for i in order} & {v for _, v, _ in own})
        by_id = dict(zip(ids, scores))
        assert all(by_id[v] == pytest.approx(s, abs=1e-12) for _, v, s in own)
    assert hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("norms", ["one long vector", "spread"])
def test_neighbours_recall_with_unlike_norms(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.where(np.arange(2000) == 7, 1e4, 1.0)[:, None] if norms == "one long vector" else 10 ** rng.uniform(0, 4, (2000, 1))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = defaultdict(set)
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 2000, 20):
        order = [i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:20]
        hits += len(found[q] & set(order))
    assert hits >= 0.9 * 20 * 100


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (9, [0.0, -1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "'x' as shard", "1 as ids", "'y' as vector")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 2, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).collect() == []


def test_chat(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    odd = [
        (-1, 0, "user", said), (-1, 1, "assistant", said), (-2, 0, "us\\n\ner<|im_end|>", "a\\<|im_sep|>\\\\<|\n<|im_end|>\n"),
        (-2, 1, "assistant", None), (-2, 2, "assistant", "\\"), (-2, 3, "assistant", "<\\|<\\\\| <\\/s> é😀"), (-2, 4, "", ""),
        (-3, None, None, None), (-4, 1, "user", "b"), (-4, 1, "user", "a"), (-4, 1, "user", "a"), (None, 0, "user", "x"), (-5, 0, "assistant", "y " * 200_000),
    ]
    rows = turns.union(spark.createDataFrame(odd, turns.schema)).selectExpr("*", "1 as rows", "2 as pieces", "3 as formatted")
    got = {r.conv_id: r for r in chat.digests(chat.read_chats(chat.format_chats(rows))).collect()}
    conversations = defaultdict(list)
    for r in rows.collect():
        conversations[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    assert set(got) == set(conversations)
    for conv, parts in conversations.items():
        parts.sort()
        told = "".join(f"{role}\n{text}\n" for *_, role, text in parts)
        learned = "".join(text for *_, role, text in parts if role == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(parts), hashlib.sha256(told.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.format_chats(rows.limit(0)).collect() == []
    plan = chat.format_chats(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    odd = [(-1, None, None), (-2, "x\ny%", "z" * 2000), (-3, "q", "z" * 2000), (-4, "q", "z" * 2000), (-5, "q", "short"), (-6, "q", "short"), (None, "q", "z" * 2000), (-7, "big", "é" * 3_000_000)]
    rows = pages.union(spark.createDataFrame(odd, pages.schema)).selectExpr("*", "1 as digest", "2 as copies")
    folder = new_path(spark, "warc")
    assert warc.write_warc(rows, folder) == rows.count()
    last = defaultdict(lambda: None)
    for r in rows.collect():
        body = (r.html or "").encode()
        if len(body) >= 1000 and r.page_id is not None:
            last[body] = max(r.page_id, r.page_id if last[body] is None else last[body])
    for split in (3_001, 70_000, 1 << 30):
        got = {r.page_id: r for r in warc.read_warc(spark, folder, split).collect()} if split > 3_001 else None
        if got is None:  # every member once, whatever the ranges, without one task for each
            path, size = max(listed(folder, ".warc.gz"), key=lambda f: f[1])
            parts = [len(list(warc.records_in(path, s, min(s + split, size)))) for s in range(0, size, split)]
            assert sum(parts) == len(list(warc.records_in(path, 0, size)))
            continue
        assert len(got) == rows.count()
        for r in rows.collect():
            body = (r.html or "").encode()
            refers = last[body] if last[body] != r.page_id else None
            g = got[r.page_id]
            assert (g.payload_bytes, g.payload_digest, g.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), refers)
            assert g.record_type == ("response" if refers is None else "revisit")
            assert g.payload is None if refers is not None else bytes(g.payload) == body


def test_warc_skips_damage_and_false_magic(spark):
    rows = spark.createDataFrame([(1, "a", "one"), (2, "b", "two")], "page_id bigint, url string, html string").coalesce(1)
    folder = new_path(spark, "warc")
    warc.write_warc(rows, folder)
    parts = []
    for path, _ in listed(folder, ".warc.gz"):
        with resolve(path)[0].open_input_file(resolve(path)[1]) as f:
            parts.append(f.read())
    path = f"{folder}/damaged.bin"
    with resolve(path)[0].open_output_stream(resolve(path)[1]) as out:
        out.write(b"junk" + warc.MAGIC + b"not a member" + parts[0][:40] + b"".join(parts) + warc.MAGIC)
    assert len(list(warc.records_in(path, 0, 10**9))) == 2
    empty = new_path(spark, "warc")
    assert warc.write_warc(rows.limit(0), empty) == 0 and warc.read_warc(spark, empty).collect() == []


def test_queries_are_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, key):
    entry = SimpleNamespace(query=contract.queries()[key], sql=contract.oracle_sql()[key])
    assert difference(spark, connect(sf_dir), sf_dir, entry) is None
