"""A source whose budget ends among equal rows still comes within one document of its target."""

from collections import Counter

import pytest

from larder.llm import mixing


def plain_targets(total, weights=(5, 2, 1), share=1.5, most=2.0):
    sources = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(sources, weights * len(sources), strict=False))
    full: set = set()
    while True:
        left = [s for s in sources if s not in full]
        level = (share * sum(total.values()) - sum(most * total[s] for s in full)) / sum(weight[s] for s in left) if left else 0.0
        more = {s for s in left if level * weight[s] >= most * total[s]}
        if not more:
            return {s: most * total[s] if s in full else level * weight[s] for s in sources}
        full |= more


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_rows(spark, parts):
    rows = [(1, "eight words stand in this one row here", "a")] * 1000 + [(i, "w " * (1 + i % 37), "b") for i in range(3000)] + [(7, "two words", None)] * 5 + [(8, None, "a"), (None, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    total, largest = Counter(), Counter()
    for _, text, source in rows:
        n = len((text or "").split())
        total[source] += n
        largest[source] = max(largest[source], n)
    want = plain_targets(total)
    taken = Counter()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, (s, taken[s], want[s])
    again = Counter()
    for r in mixing.mixed(docs).collect():
        again[r.source] += len((r.text or "").split())
    assert +again == +taken
    assert Counter(map(str, mixing.mix(docs).collect())) == Counter(map(str, got))
