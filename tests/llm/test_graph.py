"""Connected components in one partition and in rounds."""

import random

import pytest

from foliolake.llm import graph
from foliolake.llm.scratch import Scratch


@pytest.mark.parametrize("part", [40, 200_000])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)
    rnd = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(5), Scratch(spark, "t"))
    assert {(r.node, r.component) for r in got.collect()} == {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0
