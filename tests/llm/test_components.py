"""Components of links: what the rounds return, and how small their plans are."""

from __future__ import annotations

import random

from followgraph.llm import common


def _smallest(edges: list[tuple[int, int]]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent if root(x) != x}


def test_rounds_of_components_join_nothing(spark, monkeypatch):
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    written = common.written
    monkeypatch.setattr(common, "written", noted)
    draw = random.Random(3)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(120)]
    chain = [(400 + k, 401 + k) for k in range(40)]
    star = [(999, 700 + k) for k in range(30)]
    edges = [*pairs, *chain, *star, (5, 5), chain[0], chain[3][::-1]]
    got = common.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == _smallest(edges)
    assert len(plans) > 2
    assert not any("Join" in plan or "Union" in plan for plan in plans)
