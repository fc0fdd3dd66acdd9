"""Rows without doc_id in substring dedup: told apart by 64 bits of their text, equal ones are one document."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from larder.llm import suffix_dedup


def test_ids_of_texts_that_share_half_a_hash():
    hashes = pa.array([5, 5 + (1 << 32), 5 + (1 << 40), -1, 5], pa.int64())
    doc, low = suffix_dedup._ids(pa.array([None, None, None, None, 3], pa.int64()), hashes)
    assert len(set(zip(doc.tolist(), low.tolist(), strict=True))) == 5
    assert low.tolist() == [5, 5, 5, 0xFFFFFFFF, 5] and doc[4] == 3 and (doc[:4] > 1 << 62).all()


def test_null_ids_come_last_and_share_no_marks(spark):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdef ") for _ in range(150))
    # each ends in a letter of its own, so no string with the passage's beginning is in two of them
    texts = ["".join(rnd.choice("ghijk ") for _ in range(120)) + end for end in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    rows = [(None, t + passage) for t in texts] + [(None, texts[0] + passage), (7, passage), (None, None)]
    got = Counter(map(tuple, suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()))
    want = Counter()
    for doc_id, text in rows:
        # document 7 stands before all rows without id, so each of those loses the whole passage and keeps its own part
        kept = (text or "").removesuffix(passage) if doc_id is None else text
        n = len(text or "")
        want[doc_id, n, n - len(kept), int(n > len(kept)), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want
    assert np.iinfo(np.int64).max == suffix_dedup.NONE
