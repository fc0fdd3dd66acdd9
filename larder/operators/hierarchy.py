"""A strict tree of state, store, department and item: sums, weights, reconciliation and coherence.

A node's id is its path. Reconciliation is generalised least squares with a diagonal weight; on a tree it has a closed form that goes up
once and down once, so no matrix is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATH = ["state_id", "store_id", "dept_id", "item_id"]
LEVELS = ["state", "store", "dept", "item"]


def level_of(node: Column) -> Column:
    """A node's level, from the depth of its path."""
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.size(F.split(node, "/")))


def parent_of(node: Column) -> Column:
    return F.when(F.contains(node, F.lit("/")), F.regexp_replace(node, "/[^/]*$", ""))


def roll_up(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = ("date",)) -> DataFrame:
    """Sums at all four levels in one pass: node, level, keys and values."""
    sets = [[F.col(c) for c in (*PATH[: i + 1], *keys)] for i in range(len(PATH))]
    out = rows.groupingSets(sets, *PATH, *keys).agg(*(F.sum(v).alias(v) for v in values)).where("state_id is not null")
    node = F.concat_ws("/", *PATH)
    return out.select(node.alias("node"), level_of(node).alias("level"), *keys, *values)


def weights(fact: DataFrame, days: int = 28) -> DataFrame:
    """Each node's share of its level's revenue over the last days, divided by the number of levels."""
    last = fact.agg(F.max("date").alias("last"))
    recent = fact.crossJoin(F.broadcast(last)).where(F.col("date") > F.date_sub("last", days))  # one row
    sales = roll_up(recent.withColumn("revenue", F.col("units") * F.coalesce("price", F.lit(0.0))), ["revenue"], ())
    total = sales.groupBy("level").agg(F.sum("revenue").alias("total"))
    return sales.join(F.broadcast(total), "level").select("node", "level", (F.try_divide("revenue", "total") / len(LEVELS)).alias("weight"))  # four rows


def coherence(rows: DataFrame, value: str = "yhat", keys: Sequence[str] = ("model_name", "fold"), at: Sequence[str] = ("target_date",)) -> DataFrame:
    """Gaps between a parent and the sum of its children, for each pair of levels."""
    sums = rows.withColumn("parent", parent_of(F.col("node"))).where("parent is not null").groupBy("parent", *keys, *at).agg(F.sum(value).alias("children"), F.max("level").alias("child_level"))
    both = rows.withColumnRenamed("node", "parent").join(sums, ["parent", *keys, *at])
    gap = F.abs(F.col(value) - F.col("children"))
    return both.groupBy(*keys, F.col("level").alias("parent_level"), "child_level").agg(F.avg(gap).alias("mean_abs_gap"), F.max(gap).alias("max_abs_gap"), F.count("*").alias("n_checked"))


def check_tree(sums: DataFrame, value: str, tolerance: float = 1e-6) -> None:
    """An error where a parent is not the sum of its children."""
    bad = coherence(sums.withColumns({"model_name": F.lit("actual"), "fold": F.lit(0)}), value, at=("date",)).where(F.col("max_abs_gap") > tolerance).head(1)
    if bad:
        raise ValueError(f"the tree does not add up: {bad[0]}")


def reconcile(base: DataFrame, method: str = "wls_struct", keys: Sequence[str] = ("model_name", "fold", "target_date")) -> DataFrame:
    """Coherent forecasts nearest to ``base`` (node, level, keys, yhat): ``wls_struct`` weighs a node by its leaves, ``ols`` equally.

    Up: a leaf has z = its forecast and s = its variance; a node has the sums of its children's z and s, and combines its own forecast and
    the sum by precision. Down: the root takes z, and a child's share of its parent's correction is its s over the sum of s. Each step
    up is a sum by parent, partial before it is shuffled, and each step down a join on the parent, so no task holds more than it would
    of any other sum or join, however many nodes a day or a state has. ``base`` is read at each level, and should be a stored table.
    """
    if method not in ("wls_struct", "ols"):
        raise ValueError(f"unknown method {method}")
    keys, top = list(keys), len(LEVELS)
    rows = base.select("node", "level", *keys, F.col("yhat").cast("double").alias("yhat"))
    own = {d: rows.where(F.col("level") == level) for d, level in enumerate(LEVELS, 1)}
    up = {top: own[top].withColumns({"z": F.col("yhat"), "s": F.lit(1.0), "n": F.lit(1.0), "zs": F.lit(None).cast("double"), "ss": F.lit(None).cast("double")})}
    for d in range(top - 1, 0, -1):
        kids = up[d + 1].groupBy(*keys, parent_of(F.col("node")).alias("node")).agg(F.sum("z").alias("zs"), F.sum("s").alias("ss"), F.sum("n").alias("n"))
        at = own[d].join(kids, [*keys, "node"], "left")
        w = F.col("n") if method == "wls_struct" else F.lit(1.0)
        at = at.withColumn("s", F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), w) + F.try_divide(F.lit(1.0), F.col("ss"))))
        up[d] = at.withColumn("z", F.col("s") * (F.try_divide(F.col("yhat"), w) + F.try_divide(F.col("zs"), F.col("ss")))).select(*up[top].columns)
    down = up[1].withColumn("r", F.col("z"))
    found = down
    for d in range(2, top + 1):
        parents = down.select(*keys, F.col("node").alias("parent"), F.col("r").alias("above"), F.col("zs").alias("zs_above"), F.col("ss").alias("ss_above"))
        at = up[d].withColumn("parent", parent_of(F.col("node"))).join(parents, [*keys, "parent"], "left")
        down = at.withColumn("r", F.col("z") + F.try_divide(F.col("s"), F.col("ss_above")) * (F.col("above") - F.col("zs_above"))).select(*up[top].columns, "r")
        found = found.unionByName(down)
    return found.select("node", "level", *keys, "yhat", F.col("r").alias("reconciled"), F.greatest(F.lit(0.0), "r").alias("clipped"))


def gaps(sums: DataFrame, value: str, tolerance: float = 1e-6, at: Sequence[str] = ("date",)) -> DataFrame:
    """Pairs of levels with the number of parents that were compared with their children and of those that differ."""
    kids = sums.withColumn("parent", parent_of(F.col("node"))).where("parent is not null").groupBy("parent", *at).agg(F.sum(value).alias("x"), F.max("level").alias("child_level"))
    both = sums.withColumnRenamed("node", "parent").join(kids, ["parent", *at])
    return both.groupBy(F.col("level").alias("parent_level"), "child_level").agg(F.count("*").alias("n_checked"), F.count_if(F.abs(F.col(value) - F.col("x")) > tolerance).alias("n_gaps"))


def stored(reconciled: DataFrame) -> DataFrame:
    """Reconciled rows as they are kept: the path as columns, null above their level, and values of at least 0."""
    path = F.split("node", "/")
    parts = [F.try_element_at(path, F.lit(i)).alias(c) for i, c in enumerate(PATH, 1)]
    return reconciled.select("model_name", "fold", "target_date", "level", *parts, F.greatest(F.lit(0.0), "reconciled").alias("yhat"), F.lit(True).alias("reconciled"))


def filled(rows: DataFrame, nodes: DataFrame, days: DataFrame) -> DataFrame:
    """A row for every node and target day; what has no forecast gets 0, so that sums over children are whole."""
    grid = nodes.crossJoin(F.broadcast(days))  # the days of a horizon
    return grid.join(rows.select("node", "target_date", "yhat"), ["node", "target_date"], "left").withColumn("yhat", F.coalesce("yhat", F.lit(0.0)))


def whole_base(rows: DataFrame, nodes: DataFrame, ahead: DataFrame) -> DataFrame:
    """Base forecasts that reconciliation can take: each node on each target day of each fold once, whatever the models gave.

    ``rows``: node, fold, target_date, yhat, of any models, at any levels. ``ahead``: fold, target_date, as many rows as folds times days of
    a horizon. A node that no model spoke of on a day, as a series that was not listed at the origin, gets 0 and is marked ``filled``;
    so does a null forecast. A node with several forecasts of a day is an error of the caller and gets several rows; forecasts of
    unknown nodes or of other days are left out.
    """
    grid = nodes.select("node", "level").crossJoin(F.broadcast(ahead.select("fold", "target_date")))
    found = grid.join(rows.select("node", "fold", "target_date", "yhat"), ["node", "fold", "target_date"], "left")
    return found.select("node", "level", "fold", "target_date", F.coalesce(F.col("yhat").cast("double"), F.lit(0.0)).alias("yhat"), F.col("yhat").isNull().alias("filled"))


def wrmsse(series_scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted RMSSE over the nodes that have one; weights are not scaled up for the others."""
    rows = series_scores.join(weights.drop("level"), "node")
    return rows.groupBy("model_name", "fold").agg(F.sum(F.col("rmsse") * F.col("weight")).alias("wrmsse"), F.count("rmsse").alias("n_series"), F.count_if(F.col("rmsse").isNull()).alias("n_excluded"))


def tree(fact: DataFrame) -> DataFrame:
    """The tree as nested rows: a store with its departments, each with its items and their units."""
    items = fact.groupBy(*PATH).agg(F.sum("units").alias("units"))
    depts = items.groupBy("state_id", "store_id", "dept_id").agg(F.sum("units").alias("units"), F.array_sort(F.collect_list(F.struct("item_id", "units"))).alias("items"))
    return depts.groupBy("state_id", "store_id").agg(F.sum("units").alias("units"), F.array_sort(F.collect_list(F.struct("dept_id", "units", "items"))).alias("depts"))
