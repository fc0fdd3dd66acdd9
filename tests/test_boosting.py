"""Boosted trees against a plain booster on a small table, Shapley values against all coalitions, and losses on held-out days."""

import itertools
from datetime import date, timedelta
from math import factorial

import numpy as np
import pytest

from larder.operators import boosting as B

START = date(2000, 1, 1)
FEATURES = ["a", "b", "c", "flat"]
DDL = "id int, date date, a double, b double, c double, flat double, units double"


def table(n=900, seed=2):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = rnd.integers(0, 9), rnd.normal(), rnd.random()
        y = rnd.poisson(max(0.05, 1 + a * 0.7 + 2 * (b > 0.3) - 1.5 * (c < 0.2)))
        rows.append((i, START + timedelta(i // 6), float(a), None if i % 17 == 0 else float(b), float("nan") if i % 23 == 0 else float(c), 1.0, None if i % 41 == 0 else float(y)))
    return rows


def plain(rows, model, bounds, rounds, depth, rate, least, smooth, power):
    """The same booster, row by row and node by node: predictions of all rows."""
    x = [[0 if v is None or np.isnan(v) else 1 + sum(e < B.decoded(B.coded(np.array([v])))[0] for e in bounds[f]) for f, v in zip(FEATURES, r[2:6], strict=True)] for r in rows]
    own = [i for i, r in enumerate(rows) if r[1] <= model.origin and r[6] is not None]
    y = [r[6] for r in rows]
    f = [0.0] * len(rows)

    def slope(i):
        if model.level is not None:
            return (1.0 if y[i] < f[i] else 0.0) - model.level, 1.0
        a, b = y[i] * np.exp((1 - power) * f[i]), np.exp((2 - power) * f[i])
        return float(np.rint((b - a) * B.UNIT)) / B.UNIT, float(np.rint(((power - 1) * a + (2 - power) * b) * B.UNIT)) / B.UNIT

    def value(leaf, root):
        if model.level is not None:
            r = np.sort(B.coded(np.array([y[i] - f[i] for i in leaf])))
            return float(B.decoded(r[min(len(r) - 1, int(np.searchsorted(np.arange(1, len(r) + 1), model.level * len(r) * (1 - 1e-12))))]))
        g, h = (sum(s) for s in zip(*(slope(i) for i in leaf), strict=True))
        return float(np.log(max(1 - g / len(leaf), 1e-9))) if root else -g / (h + smooth)

    def grow(train, every, left, root=False):
        best = None
        if left:
            for k in range(len(FEATURES)):
                for b in range(B.BINS):
                    low = [i for i in train if x[i][k] <= b]
                    if len(low) < least or len(train) - len(low) < least:
                        continue
                    score = 0.0
                    for sign, part in ((1, low), (1, [i for i in train if x[i][k] > b]), (-1, train)):
                        g, h = (sum(s) for s in zip(*(slope(i) for i in part), strict=True))
                        score += sign * g * g / (h + smooth)
                    if score > 1e-9 and (best is None or score > best[0] + 1e-8):
                        best = score, k, b
        if best is None:
            return {i: value(train, root) for i in every}
        _, k, b = best
        out = grow([i for i in train if x[i][k] <= b], [i for i in every if x[i][k] <= b], left - 1)
        return out | grow([i for i in train if x[i][k] > b], [i for i in every if x[i][k] > b], left - 1)

    for r in range(rounds + 1):
        step = grow(own, range(len(rows)), depth if r else 0, root=r == 0)
        f = [v + step[i] * (rate if r else 1.0) for i, v in enumerate(f)]
    return f


@pytest.fixture(scope="module")
def fitted(spark):
    rows = table()
    models = [B.Model(k, START + timedelta(d), q) for k, d in enumerate((90, 120)) for q in (0.1, 0.5, 0.9, None)]
    df = spark.createDataFrame(rows, DDL).repartition(5)
    return rows, models, B.fit(df, ["id", "date"], FEATURES, "units", models, rounds=4, depth=2, rate=0.3, least=30)


def test_against_a_plain_booster(spark, fitted):
    rows, models, got = fitted
    found = {r.id: np.frombuffer(r.f, np.float64) for r in got.rows.select("id", "f").collect()}
    assert len(found) == len(rows)
    for m, model in enumerate(models):
        want = plain(rows, model, got.bounds, 4, 2, 0.3, 30, 1e-3, 1.1)
        assert [found[r[0]][m] for r in rows] == pytest.approx(want, abs=1e-6), model


def test_partitions_do_not_change_a_model(spark, fitted, monkeypatch):
    rows, models, got = fitted
    monkeypatch.setattr(B, "FAN_IN", 3)  # partial sums in several steps
    monkeypatch.setattr(B, "ROWS", 40)
    again = B.fit(spark.createDataFrame(rows, DDL).repartition(11), ["id", "date"], FEATURES, "units", models[:5], rounds=4, depth=2, rate=0.3, least=30)
    for one, two in zip(got.trees[:5], again.trees, strict=True):
        for s, t in zip(one, two, strict=True):
            assert (s.feature == t.feature).all() and (s.bin == t.bin).all() and (s.value == t.value).all() and (s.cover == t.cover).all()


def test_levels_and_means_of_held_out_days(spark):
    """After the origin a level is not reached by about its share, losses are below a constant's, and the mean is near the true one."""
    rows = table(6000, 7)
    origin = START + timedelta(700)
    models = [B.Model(0, origin, q) for q in (0.1, 0.5, 0.9, None)]
    got = B.fit(spark.createDataFrame(rows, DDL), ["id", "date"], FEATURES, "units", models, rounds=30, depth=3, rate=0.2, least=40)
    out = {(r.id, r.level): r.yhat for r in B.predictions(got, ["id", "date"], 300).collect()}
    seen = {r[0]: r[6] for r in rows if r[1] > origin and r[6] is not None}
    past = [r[6] for r in rows if r[1] <= origin and r[6] is not None]
    loss = lambda q, pairs: np.mean([max(q * (y - v), (q - 1) * (y - v)) for y, v in pairs])
    for q in (0.1, 0.5, 0.9):
        assert abs(np.mean([y < out[i, q] for i, y in seen.items()]) - q) < 0.15
        assert loss(q, [(y, out[i, q]) for i, y in seen.items()]) < 0.85 * loss(q, [(y, np.quantile(past, q)) for y in seen.values()])
    assert np.mean([out[i, None] for i in seen]) == pytest.approx(np.mean(list(seen.values())), rel=0.06)
    assert np.mean([(y - out[i, None]) ** 2 for i, y in seen.items()]) < 0.6 * np.var(list(seen.values()))


def test_shapley_values(fitted):
    """Sums equal predictions less the base; each value equals the mean over all orders of four features."""
    _, models, got = fitted
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 60, (40, 4)).astype(np.uint8)

    def part(tree, row, known, node=0):
        f = int(tree.feature[node])
        if f < 0:
            return tree.value[node]
        kids = 2 * node + 1, 2 * node + 2
        if f in known:
            return part(tree, row, known, kids[int(row[f] > tree.bin[node])])
        return sum(tree.cover[k] / tree.cover[node] * part(tree, row, known, k) for k in kids)

    for trees in (got.trees[1], got.trees[3]):
        phi, base = B.attributions(trees, x)
        whole = np.sum([t.predict(x) for t in trees], axis=0)
        assert phi.sum(axis=1) + base == pytest.approx(whole, abs=1e-6)
        for row, own in zip(x[:8], phi[:8], strict=True):
            for i in range(4):
                others = [j for j in range(4) if j != i]
                want = sum(factorial(k) * factorial(3 - k) / factorial(4) * sum(part(t, row, {*s, i}) - part(t, row, set(s)) for t in trees) for k in range(4) for s in itertools.combinations(others, k))
                assert own[i] == pytest.approx(want, abs=1e-9)


def test_importance(spark, fitted):
    _, models, got = fitted
    means = [m for m, model in enumerate(models) if model.level is None]
    rows = B.importance(got, means, 200, 5).collect()
    by = {(r.fold, r.feature, r.method): r.value for r in rows}
    assert len(rows) == len(by) == 2 * 4 * 3
    for k, m in enumerate(means):
        splits = sum((t.feature >= 0).sum() for t in got.trees[m])
        assert sum(by[k, f, "split"] for f in FEATURES) == splits and by[k, "a", "gain"] == max(by[k, f, "gain"] for f in FEATURES)
        assert by[k, "flat", "gain"] == by[k, "flat", "split"] == by[k, "flat", "shap_mean_abs"] == 0 < by[k, "a", "shap_mean_abs"]


def test_codes_keep_order_and_seven_digits():
    v = np.array([-1e9, -3.1, -3.0, -0.01, -1e-9, 0.0, 1e-9, 0.01, 0.5, 1.0, 1.02, 2.0, 129.0, 1e9])
    c = B.coded(v)
    assert (np.diff(c) >= 0).all()
    near = np.abs(v) > 0.001
    assert np.abs(B.decoded(c)[near] / v[near] - 1).max() < 1 / 128 and (B.decoded(c)[~near] == 0).all()
