"""Heavy keys: lines and nodes that go by broadcast give what the others' way gives."""

import random

import pytest
from oracle import assert_same

from lumenframe.llm import graph, line_dedup


@pytest.mark.parametrize("least", [1, 5, 10**9])
def test_lines_of_any_share(spark, sf_dir, monkeypatch, least):
    monkeypatch.setattr(line_dedup, "HEAVY", 10**9 if least < 10**9 else 1)
    monkeypatch.setattr(line_dedup, "LEAST_ROWS", least)
    assert_same(spark, sf_dir, line_dedup.op10_line_dedup, line_dedup.ORACLE)


@pytest.mark.parametrize("least", [1, 4, 10**9])
def test_components_of_any_degree(spark, monkeypatch, least):
    monkeypatch.setattr(graph, "HEAVY", 10**9)
    monkeypatch.setattr(graph, "LEAST_ROWS", least)
    r = random.Random(5)
    edges = [(7, k) for k in range(100, 140)] + [(k, k + 1) for k in range(200, 240)] + [(r.randint(0, 400), r.randint(0, 400)) for _ in range(90)] + [(5, 5)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
