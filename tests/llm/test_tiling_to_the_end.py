"""Tiling goes on while it marks anything, also left of a match cut short by a tile of the same pass."""

import numpy as np

from larder.llm import decontam


def test_left_of_a_cut_match():
    item = np.arange(1, 23, dtype=np.uint64)
    other = lambda n, at: np.arange(at, at + n, dtype=np.uint64)
    doc = np.concatenate((other(3, 100), item[6:15], other(4, 200), item[0:8], other(3, 300)))
    assert decontam.tile(doc, item) == [(3, 6, 9), (16, 0, 6)]
    found = decontam.Finder([], 0.5)
    found.rows = [(7, " ".join(f"w{x}" for x in item))]
    import pyarrow as pa

    assert [x[1:5] for x in found.find(pa.array([" ".join(f"w{x}" for x in doc)]))] == [(7, 22, 2, 15)]


def test_clean_over_many_blocks(spark):
    """What a block leaves is written before the next one is read: the same rows stay, all their columns with them."""
    from larder.llm import decontam

    items = [(i, " ".join(f"i{i}w{k}" for k in range(30))) for i in range(12)]
    docs = [(i, f"{items[i % 12][1]} and more" if i % 3 == 0 else f"clean text number {i}", i * 2) for i in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, pairs int"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, t, p) for i, t, p in docs if i % 3)
    for words in (1 << 20, 100, 30):
        got = decontam.clean(df, bench, block_words=words)
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == want
