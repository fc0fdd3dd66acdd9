"""Base forecasts of all nodes: those that no model spoke of get 0, and sums over children are whole."""

from datetime import date, timedelta

import numpy as np

from larder.operators import hierarchy as tree
from larder.operators import models

DAYS = [date(2001, 1, 1), date(2001, 1, 2)]
NODES = [("X", "state"), ("X/s", "store"), ("X/s/d", "dept"), ("X/s/d/1", "item"), ("X/s/d/2", "item"), ("X/s/d/3", "item")]


def base(spark, rows):
    ahead = spark.createDataFrame([(f, d) for f in (0, 1) for d in DAYS], "fold int, target_date date")
    return tree.whole_base(spark.createDataFrame(rows, "node string, fold int, target_date date, yhat double"), spark.createDataFrame(NODES, "node string, level string"), ahead)


def test_every_node_has_every_day_once(spark):
    """Item 3 is silent, item 2 knows one fold and has a null in it, and two rows are of no node and of no day."""
    rows = [(n, f, d, 6.0 if level != "item" else 2.0) for n, level in NODES for f in (0, 1) for d in DAYS if n != "X/s/d/3" and not (n == "X/s/d/2" and f == 0)]
    rows = [(n, f, d, None if (n, f, d) == ("X/s/d/2", 1, DAYS[0]) else y) for n, f, d, y in rows]
    rows += [("X/s/d/9", 0, DAYS[0], 5.0), ("X", 0, date(2002, 1, 1), 5.0)]
    got = {(r.node, r.fold, r.target_date): r for r in base(spark, rows).collect()}
    assert set(got) == {(n, f, d) for n, _ in NODES for f in (0, 1) for d in DAYS}
    filled = {k for k, r in got.items() if r.filled}
    assert filled == {("X/s/d/3", f, d) for f in (0, 1) for d in DAYS} | {("X/s/d/2", 0, d) for d in DAYS} | {("X/s/d/2", 1, DAYS[0])}
    assert all((r.yhat == 0.0) == r.filled for r in got.values())


def test_filled_nodes_take_part_in_reconciling(spark):
    rows = [(n, f, d, {"state": 10.0, "store": 9.0, "dept": 8.0, "item": 3.0}[level]) for n, level in NODES for f in (0, 1) for d in DAYS if n != "X/s/d/3"]
    done = tree.reconcile(base(spark, rows), keys=["fold", "target_date"]).cache()
    gaps = tree.coherence(done, "reconciled", keys=["fold"]).collect()
    assert len(gaps) == 6 and max(r.max_abs_gap for r in gaps) < 1e-9
    # least squares with weights by leaves over the whole tree, unlisted item included
    sums = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    w = np.diag([1 / 3, 1 / 3, 1 / 3, 1, 1, 1])
    leaves = np.linalg.solve(sums.T @ w @ sums, sums.T @ w @ np.array([10.0, 9, 8, 3, 3, 0]))
    got = {r.node: r.reconciled for r in done.where("fold = 0 and target_date = '2001-01-01'").collect()}
    assert np.allclose([got[n] for n, _ in NODES], sums @ leaves)
    assert got["X/s/d/3"] > 0  # the upper levels know of more than the items do


def test_nothing_in_nothing_out(spark):
    assert base(spark, []).where("not filled or yhat <> 0").isEmpty()
    empty = tree.whole_base(base(spark, []).drop("filled"), spark.createDataFrame([], "node string, level string"), base(spark, []))
    assert empty.isEmpty()


def test_smoothing_of_nodes_is_that_of_series(spark):
    """The same days under other keys give the same forecasts."""
    start = date(2000, 1, 3)
    days = [(start + timedelta(days=i), k, 5 + 3 * (i % 7 == j) + i % 3) for j, k in enumerate("ab") for i in range(80)]
    folds = [(0, start + timedelta(days=50)), (1, start + timedelta(days=70))]
    nodes = spark.createDataFrame(days, "date date, node string, units int").selectExpr("date", "node", "'dept' as level", "units")
    series = nodes.selectExpr("date", "node as item_id", "level as store_id", "units")
    one = models.ets(nodes, folds, (0.5,), 14, keys=["node", "level"]).selectExpr("fold", "node as k", "target_date", "yhat")
    two = models.ets(series, folds, (0.5,), 14).selectExpr("fold", "item_id as k", "target_date", "yhat")
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 2 * 2 * 14
