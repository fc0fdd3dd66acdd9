"""Near duplicates among texts that share much else: members of crowded tables that are unlike all leads are still joined."""

import random

from larder.llm import near_dup


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_pairs_among_texts_with_common_passages(spark):
    """120 pairs at a similarity of 0.75 to 0.8, each beside texts that share 15 to 65 % of their words with it and with all others: all links are found."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    rows, links = [], []
    for common_size in (60, 120, 200, 260):
        common = [word() for _ in range(common_size)]
        for _ in range(30):
            base = common + [word() for _ in range(400 - common_size)]
            own = shingles(base)
            other = list(base)
            # change words from the end on until the two are just similar enough
            for k in range(1, 200):
                trial = base[:-k] + [f"x{rnd.randrange(10**6)}" for _ in range(k)]
                same = len(own & shingles(trial))
                if 100 * same < 75 * (len(own | shingles(trial))):
                    break
                other = trial
            links.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    docs = spark.createDataFrame([(order[i], t) for i, t in rows], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    missed = [1 for a, b in links if found[order[a]] != found[order[b]] or found[order[a]] != min(order[a], order[b])]
    assert len(links) == 120 and len(missed) == 0
