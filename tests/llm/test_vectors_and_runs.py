"""Near vectors, hard negatives and periodic runs against brute force, with nulls, empties, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from larder.llm import embedding_dedup as E
from larder.llm import hard_negatives as H
from larder.llm import periodic_runs as R

VECTORS = "vec_id long, embedding array<double>, label int, class string, n int, home string, v int, rid string, part int"
EXTRA = ("c", 1, "h", 2, "r", 3)


def cosine(x, y):
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max())[1]).tolist() for v in (x, y))
    dot = math.fsum(a * b for a, b in zip(x, y, strict=True))
    return dot / math.sqrt(math.fsum(a * a for a in x) * math.fsum(b * b for b in y))


def usable(x):
    return bool(x) and all(a is not None and math.isfinite(a) for a in x) and any(x)


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(3)
    near = lambda v, s: v + s * rnd.standard_normal(len(v))
    base = [rnd.standard_normal(16) for _ in range(30)]
    rows = [*base, *(near(v, s) for v in base[:12] for s in (0.01, 0.05, 0.15, 0.25, 0.3)), *([base[0]] * 40), *(near(base[1], 0.02) for _ in range(80)), *(near(base[2], 0.2) for _ in range(60))]
    rows += [2 * base[3], -base[4], 1e30 * base[5], 1e-300 * base[5], base[6][:9], base[6][:9]]
    rows += [[20.0, 0, 0, 0], [19.0, 6, 1, math.sqrt(2)], [19.0, 5, 3, math.sqrt(5)], [19.0, 6, 1, 1.4142]]  # at the bound, or nearly
    rows = [[float(x) for x in r] for r in rows] + [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 3, [float("inf"), 1.0], [-0.0, 1.0], [0.0, 1.0]]
    out = [(i, r, [3, 5, 9, None][i % 4] if i % 11 else 7, *EXTRA) for i, r in enumerate(rows)]
    return [*out, out[0], (None, rows[0], 3, *EXTRA), (None, None, None, *EXTRA), (-100, rows[1], 5, *EXTRA), (100, rows[1], 5, *EXTRA), (100, rows[3], 7, *EXTRA)]


def near_by_force(rows):
    n = len(rows)
    fine = [usable(r[1]) for r in rows]
    links = [[j for j in range(n) if j != i and fine[i] and fine[j] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.95] for i in range(n)]
    out = Counter()
    for i in range(n):
        seen, ahead = {i}, [i]
        while ahead:
            new = set(links[ahead.pop()]) - seen
            seen |= new
            ahead += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out[rows[i][0], len(links[i]), least, rows[i][0] == least] += 1
    return out


@pytest.mark.parametrize("block", [E.BLOCK, 8])
def test_near_vectors(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)  # 8: most tables are dealt over pairs of blocks
    df = spark.createDataFrame(vectors, VECTORS).repartition(5)
    assert Counter(tuple(r) for r in E.near_vectors(df).collect()) == near_by_force(vectors)


def test_near_vectors_of_nothing(spark):
    assert E.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    assert [tuple(r) for r in E.near_vectors(spark.createDataFrame([(4, [1.0, 2.0], 1, *EXTRA)], VECTORS)).collect()] == [(4, 0, 4, True)]


def test_recall_at_the_bound(spark):
    """Pairs at a cosine of 0.95 to 0.955, each apart from all others: at least 0.99 are found."""
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        x, y = rnd.standard_normal((2, 48))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.95 + 0.005 * rnd.random() + 1e-9
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + math.sqrt(1 - c * c) * y).tolist())]
    found = E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links = 1").count()
    assert found >= 0.99 * len(rows)


def test_keys_do_not_depend_on_the_batch():
    x = np.random.default_rng(1).standard_normal((64, 33))
    whole = E.keys(x, 19, 7)
    assert all((E.keys(x[i : i + 1], 19, 7)[0] == whole[i]).all() for i in range(64)) and len(np.unique(whole)) > 400


def negatives_by_force(rows):
    part = []
    for vec_id, x, label, *_ in rows:
        if label is None or x is None or not all(a is not None and math.isfinite(a) for a in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        part.append((vec_id, label, [max(-H.BOUND, min(H.BOUND, math.floor(max(-1e15, min(1e15, 256 * a))))) for a in x]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda s, i: (-s, i is None, i or 0)
    out = Counter()
    for i, (anchor, label, x) in enumerate(part):
        if anchor is None or anchor % 100:
            continue
        scored = [(score(x, y), b, m == label) for j, (b, m, y) in enumerate(part) if j != i]
        for s, positive, _ in sorted((p for p in scored if p[2]), key=lambda p: order(p[0], p[1]))[:5]:
            inside = sorted((order(t, b), b, t) for t, b, same in scored if not same and 80 * s <= 100 * t <= 100 * s)[:5]
            out.update((anchor, positive, k, b, s, t) for k, (_, b, t) in enumerate(inside, 1))
    return out


@pytest.mark.parametrize("part", [H.PART, 20])
def test_hard_negatives(spark, vectors, part, monkeypatch):
    monkeypatch.setattr(H, "PART", part)
    rnd = random.Random(4)
    grid = [(1000 + i, [float(rnd.randrange(-2, 3)) / 4 for _ in range(rnd.choice([7, 8]))], rnd.randrange(3), *EXTRA) for i in range(400)]  # many ties
    rows = vectors + grid + [(50_000 + 100 * i, r[1], r[2], *EXTRA) for i, r in enumerate(vectors[:60])]
    df = H.relabelled(H.taking_part(spark.createDataFrame(rows, VECTORS).repartition(4)))
    got = Counter(tuple(r) for r in H.mine(df, H.F.expr("vec_id % 100 = 0")).collect())
    assert got == negatives_by_force(rows) and len(got) > 300


def test_bounds_hold_and_tighten():
    rnd = np.random.default_rng(2)
    x, y = H.Summaries(np.floor(256 * (rnd.standard_normal((20, 64)) + 1))), H.Summaries(np.floor(256 * rnd.standard_normal((30, 64))))
    all_, exact, before = np.ones((20, 30), bool), x.x @ y.x.T, np.inf
    for level in range(len(H.SEGMENTS)):
        low, high = x.bounds(y, level, all_)
        assert (low <= exact).all() and (exact <= high).all() and (high - low).sum() < before
        before = (high - low).sum()


def test_hard_negatives_of_nothing(spark):
    assert H.mine(H.relabelled(H.taking_part(spark.createDataFrame([], VECTORS))), H.F.expr("vec_id % 100 = 0")).collect() == []


def runs_by_force(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def digest_by_force(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = runs_by_force(w)
    best = (None,) * 4
    if runs:
        s, m, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, m, q, 1000 * m // q)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop))


def test_periodic_runs(spark, monkeypatch):
    monkeypatch.setattr(R, "ASK", 5000)
    rnd = random.Random(6)

    def repeated(n, k, share):
        w = [f"w{rnd.randrange(k)}é" for _ in range(n)]
        a, p = rnd.randrange(n), 1 + rnd.randrange(n) // 5
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        return " ".join(rnd.choice("xyz") if rnd.random() < share else x for x in w)

    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    texts = [None, "", "  \n", "one", "a " * 23, "a " * 24, "A a " * 30, "x\ty\x0bz\x0c " * 9, "ab " * 3000, " ".join(b), " ".join(["a"] * 50) + " b"]
    texts += [repeated(rnd.choice([20, 60, 200, 500]), rnd.choice([2, 3, 6, 1000]), rnd.choice([0, 0, 0.01])) for _ in range(150)]
    texts += [" ".join(f"v{rnd.randrange(5000)}" for _ in range(9000)), "same line here\n" * 40 + "tail " * 30]
    rows = [(i, t, "runs", 1, "w", 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], (None, texts[8], "", 0, "", 0, 0, 0), (-7, texts[9], "", 0, "", 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n int, w string, g int, a int, h int").repartition(3)
    got = R.digests(R.find_runs(R.planted(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(digest_by_force(r[0], r[1]) for r in rows)
    assert R.digests(R.find_runs(R.planted(docs.limit(0)))).collect() == []


def test_agreement_of_all_places():
    rnd = np.random.default_rng(5)
    for size in (2, 3, 40):
        s = np.concatenate(([-1], rnd.integers(0, size, 120), [-2], np.tile(rnd.integers(0, size, 7), 12), [-3]))
        levels = R.grammar(s, size)
        p, q = np.triu_indices(len(s), 1)
        n = len(s)
        ahead = [next(k for k in range(n) if j + k >= n or s[i + k] != s[j + k]) for i, j in zip(p, q, strict=True)]
        back = [next(k for k in range(n) if i - k < 0 or s[i - k] != s[j - k]) for i, j in zip(p, q, strict=True)]
        inside = (s[p] >= 0) & (s[q] >= 0)
        assert (R.agreement(levels, p[inside], q[inside]) == np.array(ahead)[inside]).all()
        assert (R.agreement(levels, p[inside], q[inside], ahead=False) == np.array(back)[inside]).all()
