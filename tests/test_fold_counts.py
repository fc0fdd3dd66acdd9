"""Backtests of products from counted values, against folds that are cut out and worked on one by one."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from larder.operators import products, service

AHEAD, RATIO = 14, 0.4087
LENGTHS = {"whole": 150, "decimal": 131, "gaps": 140, "short": 45, "one": 20, "late": 120, "silent": 100}


@pytest.fixture(scope="module")
def histories():
    """Whole and decimal units, days without a record, products too short for any fold, one whose sales begin late, and one without any record."""
    rnd, out = random.Random(5), {}
    for sku, n in LENGTHS.items():
        days = [date(2001, 1, 1) + timedelta(days=i) for i in range(n)]
        units = [float(rnd.randint(0, 6)) for _ in days]
        if sku == "decimal":
            units = [round(rnd.random() * 9, 3) for _ in days]
        elif sku == "gaps":
            units = [None if rnd.random() < 0.3 else u for u in units]
        elif sku == "late":
            units = [0.0 if i < 100 else u + 1 for i, u in enumerate(units)]
        elif sku == "silent":
            units = [None] * n
        out[sku] = list(zip(days, units, strict=True))
    return out


@pytest.fixture(scope="module")
def series(spark, histories):
    rows = [(sku, d, u) for sku, days in histories.items() for d, u in days]
    return spark.createDataFrame(rows, "sku string, date date, units_sold double")


def origins(days):
    n = max(0, min(5, (len(days) - 28) // AHEAD))
    return [(f, days[-1][0] - timedelta(days=(n - f) * AHEAD)) for f in range(n)]


def test_baseline_equals_folds_cut_out(series, histories):
    want = {}
    for sku, days in histories.items():
        for fold, origin in origins(days):
            train = [(d, u) for d, u in days if u is not None and d <= origin]
            test = [(d, u) for d, u in days if u is not None and origin < d <= origin + timedelta(days=AHEAD)]
            v = np.array([u for _, u in train])
            if len(v) < 7 or not test:
                continue
            offset = np.quantile(v[7:] - v[:-7], 0.5) if len(v) > 7 else 0.0
            first = next((i for i, u in enumerate(v) if u > 0), len(v))
            steps = np.abs(np.diff(v))[first:]
            totals = [v[i : i + AHEAD].sum() for i in range(len(v) - AHEAD + 1)]
            path = [max(0.0, v[-7:][((d - origin).days - 1) % 7] + offset) for d, _ in test]
            mae, gap = np.mean([abs(u - p) for (_, u), p in zip(test, path, strict=True)]), sum(u for _, u in test) - max(0.0, np.quantile(totals, RATIO))
            want[sku, fold] = (mae / steps.mean() if len(steps) and steps.mean() > 1e-12 else None, max(RATIO * gap, (RATIO - 1) * gap))
    got = {(r.sku, r.fold): (r.mase, r.pinball) for r in service.sku_backtest(series, AHEAD, RATIO).collect()}
    assert set(got) == set(want) and {s for s, _ in got} == {"whole", "decimal", "gaps", "short", "late"}
    for k, (mase, pinball) in want.items():
        assert (got[k][0] is None) == (mase is None) and (mase is None or math.isclose(got[k][0], mase, rel_tol=1e-9)), k
        assert math.isclose(got[k][1], pinball, rel_tol=1e-9, abs_tol=1e-9), k


def test_learned_quantiles_equal_folds_cut_out(series, histories):
    """Leaves of weekday and trend, and of the trend for totals; the trend of a day is that of fourteen records earlier."""
    cut = service.sku_folds(series, AHEAD)
    rows = products.learning_rows(series, AHEAD)
    daily, totals = (x.collect() for x in products.learned(rows, cut, AHEAD, (0.25, 0.5)))
    got, whole = {(r.sku, r.fold, r.date): r.quantiles for r in daily}, {(r.sku, r.fold): r.quantiles for r in totals}
    want, want_totals = {}, {}
    mean = lambda v, i, n: round(float(np.mean(v[max(0, i - n + 1) : i + 1])), 6)
    for sku, days in histories.items():
        seen = [(d, u) for d, u in days if u is not None]
        v = [u for _, u in seen]
        rising = [mean(v, i, products.SHORT) > mean(v, i, products.LONG) for i in range(len(v))]
        for fold, origin in origins(days):
            n = sum(d <= origin for d, _ in seen)
            ends = n - AHEAD
            if n < products.MIN_DAYS or ends < products.MIN_TOTALS:
                continue
            before = lambda i: rising[i - AHEAD] if i >= AHEAD else False
            for h in range(1, AHEAD + 1):
                d = origin + timedelta(days=h)
                leaf = [v[i] for i in range(n) if seen[i][0].weekday() == d.weekday() and before(i) == rising[n - 1]]
                want[sku, fold, d] = np.quantile(leaf or v[:n], (0.25, 0.5))
            sums = [(sum(v[i + 1 : i + 1 + AHEAD]), rising[i]) for i in range(ends)]
            want_totals[sku, fold] = np.quantile([s for s, r in sums if r == rising[n - 1]] or [s for s, _ in sums], (0.25, 0.5))
    assert set(got) == set(want) and set(whole) == set(want_totals) and len(whole) > 8
    assert all(np.allclose(got[k], want[k]) for k in want) and all(np.allclose(whole[k], want_totals[k]) for k in want_totals)


def test_no_day_is_copied_into_folds(series):
    """Of whole units, what folds get is far less than their days."""
    rows = service.with_origins(series.where("units_sold is not null").selectExpr("sku", "date", "units_sold as v"), service.sku_folds(series, AHEAD)).withColumn("span", service.span(products.F.col("date")))
    F = products.F
    mark = F.struct(F.lit("v").alias("kind"), F.col("span"), F.col("v").alias("value"))
    counts = service.value_counts(rows, [mark], []).where("sku = 'whole'")
    assert counts.agg(F.sum("n")).first()[0] == sum(150 - AHEAD * (5 - f) for f in range(5))
    assert counts.count() <= 7 * (1 + 2 + 3 + 4 + 5)  # seven values a span, and its spans a fold
