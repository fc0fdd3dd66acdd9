"""Components of a graph: the smallest node of each, and no round where there is nothing to do."""

import random

import pytest

from larder.llm import graph, near_dup
from larder.llm.scratch import Scratch


def brute(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {x: find(x) for x in root}


def frame(spark, edges, names="a long, b long"):
    return spark.createDataFrame(edges, names)


@pytest.fixture
def saved(monkeypatch):
    names, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: names.append(name) or save(self, df, name))
    return names


def test_stars_need_no_round(spark, saved):
    edges = [(1, x) for x in range(2, 9)] + [(20, 10), (10, 30), (7, 7)]
    got = {r.node: r.root for r in graph.components(frame(spark, edges), Scratch(spark, "test")).collect()}
    assert got == brute(edges) and saved == ["edges", "components"]


def test_against_brute_force(spark):
    rnd = random.Random(1)
    path = [(x, x + 1) for x in range(40)]
    rnd.shuffle(path)
    for edges in (path, [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)], [(5, x) for x in range(30)] + [(29, 40), (41, 40)], []):
        got = [(r.node, r.root) for r in graph.components(frame(spark, edges), Scratch(spark, "test")).collect()]
        assert sorted(got) == sorted(brute(edges).items())


def test_more_edges_join_clusters_by_their_roots(spark, saved):
    edges, more = [(1, 2), (2, 3), (10, 11), (20, 21), (5, 6)], [(11, 3), (21, 40), (41, 42), (6, 5)]
    found = frame(spark, sorted(brute(edges).items()), "node long, root long")
    got = [(r.node, r.root) for r in near_dup._merged(found, frame(spark, more), Scratch(spark, "test")).collect()]
    assert sorted(got) == sorted(brute(edges + more).items()) and saved == ["edges", "components"]
