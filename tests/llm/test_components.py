import random

import pytest

from strideframe.llm import components as C


@pytest.mark.parametrize("chunk", [1_000_000, 3])
def test_components_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rng = random.Random(chunk)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else find(parent[i])

    for u, v in links:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = C.components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((i, find(i)) for i in parent)


def test_no_links(spark):
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0
