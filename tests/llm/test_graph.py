"""Connected components against union-find."""

import random

import pytest

from cuemill.llm._graph import components


def by_union(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


R = random.Random(1)
CASES = {
    "empty": [],
    "loop": [(3, 3)],
    "both ways": [(1, 2), (2, 1)],
    "chain": [(i, i + 1) for i in range(40)],
    "hub": [(0, i) for i in range(1, 30)] + [(29, 50), (50, -4)],
    "random": [(R.randrange(-60, 60), R.randrange(-60, 60)) for _ in range(55)],
    "hub among many": [(0, i) for i in range(1, 400)] + [(k, k + 1) for k in range(1000, 4000, 3)] + [(399, 1000), (4001, 7)],
    "great hub": [(9000, i) for i in range(400)] + [(R.randrange(400, 8000), R.randrange(400, 8000)) for _ in range(1500)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    rows = components(spark.createDataFrame(CASES[name], "u bigint, v bigint")).collect()
    got = {r.node: r.root for r in rows}
    assert len(got) == len(rows)
    assert got == by_union(CASES[name])
