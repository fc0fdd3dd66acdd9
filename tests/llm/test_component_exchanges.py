"""A round of components moves the edges twice; equal edges and loops change nothing."""

import random

from larder.llm.graph import components
from larder.llm.scratch import Scratch


class Counting(Scratch):
    def __init__(self, spark, name):
        super().__init__(spark, name)
        self.exchanges = []

    def save(self, df, name):
        if name == "edges":
            self.exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return super().save(df, name)


def test_rounds(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    edges += edges[:50] + [(b, a) for a, b in edges[:50]] + [(7, 7)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    scratch = Counting(spark, "exchanges")
    rows = components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {(r.node, r.root) for r in rows} == {(x, root(x)) for e in edges if e[0] != e[1] for x in e}
    assert scratch.exchanges[0] == 0 and len(scratch.exchanges) > 1 and set(scratch.exchanges[1:]) == {2}
