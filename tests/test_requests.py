"""Requests answered from sums: against the orders row by row, and what is wrong with a request."""

import math
import random
from datetime import date, timedelta

import pytest

from larder import schema as S
from larder.functions.costs import CostModel
from larder.operators import ordering, requests

ASKED = "request_id long, item_id string, fold int, horizon int, margin double, spoilage double, holding double"


@pytest.fixture(scope="module")
def panel(spark):
    """Two items, three and one stores, two folds; some rows without any demand, whose levels are all equal."""
    rnd, rows = random.Random(9), []
    for item, stores in (("a", 3), ("b", 1)):
        for store in range(stores):
            for fold in (0, 1):
                for h in range(1, S.HORIZON + 1):
                    values = sorted(rnd.choice((0.0, rnd.random() * 20)) for _ in S.LEVELS) if rnd.random() < 0.8 else [0.0] * len(S.LEVELS)
                    rows.append(("m", fold, item, f"s{store}", date(2001, 1, 1) + timedelta(days=28 * fold + h), h, *values, float(rnd.randint(0, 9)), rnd.choice((1.0, 2.5, 3.0))))
    levels = ", ".join(f"`{q}` double" for q in S.LEVELS)
    return spark.createDataFrame(rows, f"model_name string, fold int, item_id string, store_id string, target_date date, horizon int, {levels}, demand double, price double")


def asked(spark, panel, rows, folds=((0,), (1,))):
    known = requests.checked(spark.createDataFrame(rows, ASKED), spark.createDataFrame(list(folds), "fold int"), panel, CostModel())
    return requests.answers(known, requests.sums_ahead(panel)).collect()


def test_sums_answer_as_rows_do(spark, panel):
    costs = [(0.3, 0.6, 0.02), (0.5, 0.0, 0.1), (0.12, 0.9, 0.0), (0.9, 0.1, 0.0), (0.3, 1.0, 0.02)]
    rows = [(n, item, fold, days, *costs[n % len(costs)]) for n, (item, fold, days) in enumerate((i, f, d) for i in "ab" for f in (0, 1) for d in (1, 2, 13, 28))]
    got = {r.request_id: r for r in asked(spark, panel, rows)}
    for n, item, fold, days, *cost in rows:
        orders = ordering.order_policy(panel.where((panel.item_id == item) & (panel.fold == fold) & (panel.horizon <= days)), CostModel(*cost)).collect()
        assert got[n].fault is None and got[n].n_stores == len({r.store_id for r in orders})
        assert math.isclose(got[n].order_qty, sum(r.order_qty for r in orders), abs_tol=1e-9)
        assert math.isclose(got[n].expected_cost, sum(r.expected_cost for r in orders), abs_tol=1e-9)
        assert got[n].demand == sum(r.demand for r in orders)
    # a ratio that is a level takes its sum as it is
    exact = asked(spark, panel, [(1, "a", 0, 28, 0.5, 1.0, 0.0)])[0]
    assert exact.critical_ratio == 0.5 and math.isclose(exact.order_qty, sum(r["0.5"] for r in panel.where("item_id = 'a' and fold = 0").collect()))
    # the greatest level has none above it
    top = asked(spark, panel, [(1, "b", 1, 28, 0.99, 0.99, 0.01)])[0]
    assert math.isclose(top.critical_ratio, 0.99) and top.fault is None and top.order_qty is not None


def test_gaps_are_filled_and_repeats_answered(spark, panel):
    full, gaps, again = (next(r for r in asked(spark, panel, [(1, "a", 1, 28, 0.3, 0.6, 0.02), (2, "a", None, None, None, None, None), (2, "a", None, None, None, None, None)]) if r.request_id == k) for k in (1, 2, 2))
    assert full[3:] == gaps[3:] == again[3:] and gaps.fold == 1 and gaps.horizon == S.HORIZON


@pytest.mark.parametrize(("row", "fault"), [
    ((1, None, 0, 5, 0.3, 0.6, 0.0), "no such item"), ((1, "c", 0, 5, 0.3, 0.6, 0.0), "no such item"), ((1, "a", 2, 5, 0.3, 0.6, 0.0), "no such fold"),
    ((1, "a", 0, 0, 0.3, 0.6, 0.0), "the horizon must lie in 1 to 28"), ((1, "a", 0, 29, 0.3, 0.6, 0.0), "the horizon must lie in 1 to 28"),
    ((1, "a", 0, 5, 1.0, 0.6, 0.0), "the margin must lie between 0 and 1"), ((1, "a", 0, 5, math.nan, 0.6, 0.0), "the margin must lie between 0 and 1"),
    ((1, "a", 0, 5, 0.3, 1.1, 0.0), "spoilage must lie in 0 to 1"), ((1, "a", 0, 5, 0.3, math.nan, 0.0), "spoilage must lie in 0 to 1"),
    ((1, "a", 0, 5, 0.3, 0.6, -0.1), "holding must not be negative"), ((1, "a", 0, 5, 0.3, 0.6, math.nan), "holding must not be negative"),
    ((1, "a", 0, 5, 0.3, 0.0, 0.0), "the critical ratio lies outside the quantiles"),
    ((None, "c", 7, 90, 0.0, 2.0, -1.0), "no such item; no such fold; the horizon must lie in 1 to 28; the margin must lie between 0 and 1; spoilage must lie in 0 to 1; holding must not be negative"),
])
def test_faults(spark, panel, row, fault):
    (got,) = asked(spark, panel, [row])
    assert got.fault == fault and (got.order_qty, got.expected_cost, got.demand, got.n_stores) == (None, None, None, None)


def test_nothing_to_ask_or_to_answer_from(spark, panel):
    assert asked(spark, panel, []) == []
    (got,) = asked(spark, panel, [(1, "a", None, None, None, None, None)], folds=())
    assert got.fault == "no such fold"
    known = requests.checked(spark.createDataFrame([(1, "a", 1, 3, None, None, None)], ASKED), spark.createDataFrame([(1,)], "fold int"), panel, CostModel())
    (got,) = requests.answers(known, requests.sums_ahead(panel.where("fold = 0"))).collect()
    assert got.fault == "no forecast" and got.order_qty is None


def test_reports_match_what_is_asked(spark):
    rows = spark.createDataFrame([("tsb", 0, "mase"), ("tsb", 3, "pinball_q50"), ("ets", 3, "pinball_q95"), (None, 4, "mase")], "model_name string, fold int, metric string")
    found = lambda **w: sorted((r.model_name or "", r.fold) for r in requests.matching(rows, **w).collect())
    assert found(model_name="tsb") == [("tsb", 0), ("tsb", 3)] and found(fold=(3, 4)) == [("", 4), ("ets", 3), ("tsb", 3)]
    assert found(metric="pinball_q*", model_name=["ets", "none"]) == [("ets", 3)] and len(found(model_name=None)) == 4 and found(fold=[]) == []
    with pytest.raises(ValueError, match="unknown filter level"):
        requests.matching(rows, level="item")
