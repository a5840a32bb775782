"""Components against a plain search, on chains, stars and random graphs."""

from __future__ import annotations

import random

import pytest

from failwatch.llm.components import connected_components


def plain(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in found:
                found[node] = start
                todo += near[node]
    return found


def chain(order):
    return list(zip(order, order[1:]))


RNG = random.Random(2)
SHUFFLED = RNG.sample(range(500), 500)
GRAPHS = {
    "chain": chain(range(400)),
    "shuffled chain": chain(SHUFFLED),
    "star around the largest": [(999, i) for i in range(300)],
    "zigzag": chain([x for i in range(150) for x in (i, 1000 - i)]),
    "random": [(RNG.randrange(2000), RNG.randrange(2000)) for _ in range(1400)],
    "odd": [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.node: r.component for r in connected_components(df).collect()} == plain(edges)
