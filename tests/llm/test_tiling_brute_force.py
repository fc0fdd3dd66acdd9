"""Decontamination against a naive tiler over all pairs of a document and an item, and against planted hot and repeated items."""

import random
import re
from collections import Counter

from larder.llm import decontam

LEAST = 5


def naive_tiled(doc, item):
    """Words of the item under tiles: the longest common run of unmarked words again and again, found by trying every pair of places."""
    least, free_d, free_i, tiled, tiles = min(LEAST, len(item)), [True] * len(doc), [True] * len(item), 0, 0
    while least:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            break
        free_d[i : i + n] = [False] * n
        free_i[j : j + n] = [False] * n
        tiled, tiles = tiled + n, tiles + 1
    return tiled


def made(seed):
    rnd = random.Random(seed)
    lexicon = [f"w{i}" for i in range(300)]
    say = lambda n: [rnd.choice(lexicon) for _ in range(n)]
    items = [say(rnd.choice([3, 4, 8, 20, 35])) for _ in range(12)]
    docs = []
    for n in range(60):
        words = say(rnd.randint(0, 60))
        item = items[n % len(items)]
        cut = sorted(rnd.sample(range(len(item) + 1), 2)) if n % 4 else [0, len(item)]
        pieces = [item[: cut[0]], item[cut[0] : cut[1]], item[cut[1] :]]
        rnd.shuffle(pieces)
        for piece in pieces[: rnd.randint(1, 3)]:
            at = rnd.randint(0, len(words))
            words[at:at] = piece
        if n % 5 == 0 and words:
            words[rnd.randrange(len(words))] = "odd"
        docs.append(words)
    return docs, items


def test_all_pairs(spark):
    docs, items = made(11)
    rows = [(i, (" " if i % 3 else "\n").join(w).upper() if i % 7 == 0 else " ".join(w)) for i, w in enumerate(docs)] + [(None, " ".join(docs[4])), (4, " ".join(docs[4])), (99, None), (98, "")]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(0, " ".join(items[0]))] * 3 + [(None, " ".join(items[1])), (77, None), (78, " \n")]
    want = Counter()
    for doc_id, text in rows:
        for item_id, item in bench:
            d, i = re.findall(r"\S+", (text or "").lower()), re.findall(r"\S+", (item or "").lower())
            if i and 2 * (n := naive_tiled(d, i)) >= len(i):
                want[doc_id, item_id, len(i), n] += 1
    docs_df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, item_id string, n_tiled int").repartition(3)
    bench_df = spark.createDataFrame([(*r, 7) for r in bench], "item_id long, text string, doc_id int").repartition(2)
    for block_words in (decontam.BLOCK_WORDS, 40):
        got = Counter((r.doc_id, r.item_id, r.n_item_words, r.n_tiled) for r in decontam.contaminated(docs_df, bench_df, block_words=block_words).collect())
        assert got == want
    assert len(want) >= 30  # the fixture does plant matches
    dirty = {d for d, *_ in want}
    left = decontam.clean(docs_df, bench_df, block_words=40)
    assert left.columns == docs_df.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in rows if d not in dirty)
