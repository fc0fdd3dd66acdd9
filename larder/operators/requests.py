"""Requests answered together: each row of a table asks about one item, is checked against bounds, and is answered from sums.

An order at a critical ratio is linear between two levels of a row's quantiles, and so is its expected cost while the ratio lies between
them. Sums of quantiles, plain and times the price, of an item's first days ahead therefore answer any request exactly: the forecasts are
summed once, and a request is one lookup, whatever its costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import schema as S
from larder.functions.costs import CostModel, bin_masses
from larder.operators.ordering import level_columns

# Bounds of a request's days ahead.
LEAST_DAYS, MOST_DAYS = 1, S.HORIZON


def sums_ahead(panel: DataFrame, levels: Sequence[float] = S.LEVELS) -> DataFrame:
    """For each item, fold and number of days ahead: sums over stores and over the days up to it of quantiles, of price times quantiles, and
    of demand. ``panel``: a column for each level, sorted over levels and at least 0, with price, demand, fold and horizon."""
    values = level_columns(levels)
    one = panel.groupBy("item_id", "fold", "horizon").agg(
        *(F.sum(v).alias(f"v{i}") for i, v in enumerate(values)), *(F.sum(v * F.col("price")).alias(f"p{i}") for i, v in enumerate(values)), F.sum("demand").alias("d"), F.count("*").alias("n"))
    up_to = Window.partitionBy("item_id", "fold").orderBy("horizon")  # the days of a horizon
    running = lambda c: F.sum(c).over(up_to)
    places = range(len(values))
    return one.select("item_id", "fold", "horizon", F.array(*(running(f"v{i}") for i in places)).alias("sums"), F.array(*(running(f"p{i}") for i in places)).alias("priced"), running("d").alias("demand"), F.max("n").over(up_to).alias("n_stores"))


def checked(requests: DataFrame, folds: DataFrame, items: DataFrame, defaults: CostModel, levels: Sequence[float] = S.LEVELS) -> DataFrame:
    """Requests with their gaps filled, their critical ratio, and ``fault``: everything that is wrong with them, null if nothing is.

    ``requests``: request_id, item_id, fold, horizon, margin, spoilage, holding; a null fold is the latest, a null horizon the longest, a null
    cost the default. NaN is out of all bounds. A request of no item is one of an unknown item.
    """
    newest = folds.agg(F.min("fold").alias("oldest"), F.max("fold").alias("newest"))
    rows = requests.crossJoin(F.broadcast(newest))  # one row
    rows = rows.withColumns({
        "fold": F.coalesce("fold", "newest"), "horizon": F.coalesce("horizon", F.lit(MOST_DAYS)), "margin": F.coalesce("margin", F.lit(defaults.margin)),
        "spoilage": F.coalesce("spoilage", F.lit(defaults.spoilage)), "holding": F.coalesce("holding", F.lit(defaults.holding))})
    rows = rows.join(items.select("item_id").distinct().withColumn("known", F.lit(True)), "item_id", "left")
    over = (1 - F.col("margin")) * (F.col("spoilage") + F.col("holding"))
    ratio = F.try_divide("margin", F.col("margin") + over)
    inside = lambda c, low, high: F.coalesce(F.col(c).between(low, high), F.lit(False))
    costs_good = (F.col("margin") > 0) & (F.col("margin") < 1) & inside("spoilage", 0.0, 1.0) & (F.col("holding") >= 0) & ~F.isnan("holding")
    faults = F.array_compact(F.array(
        F.when(F.col("known").isNull(), "no such item"),
        F.when(F.col("newest").isNull() | ~inside("fold", F.col("oldest"), F.col("newest")), "no such fold"),
        F.when(~inside("horizon", LEAST_DAYS, MOST_DAYS), f"the horizon must lie in {LEAST_DAYS} to {MOST_DAYS}"),
        F.when(~((F.col("margin") > 0) & (F.col("margin") < 1)), "the margin must lie between 0 and 1"),
        F.when(~inside("spoilage", 0.0, 1.0), "spoilage must lie in 0 to 1"),
        F.when(~((F.col("holding") >= 0) & ~F.isnan("holding")), "holding must not be negative"),
        F.when(costs_good & ~ratio.between(levels[0], levels[-1]), "the critical ratio lies outside the quantiles"),
    ))
    fault = F.when(F.size(faults) > 0, F.array_join(faults, "; "))
    return rows.select(*requests.columns, F.when(costs_good, ratio).alias("critical_ratio"), fault.alias("fault"))


def _at(values: str, k: Column, w: Column) -> Column:
    low = F.get(values, k)
    return low + F.when(w > 0, w * (F.get(values, k + 1) - low)).otherwise(0.0)


def answers(requests: DataFrame, sums: DataFrame, levels: Sequence[float] = S.LEVELS) -> DataFrame:
    """Checked requests with the order of all stores over the days asked for, its expected cost, and the demand; nulls with a fault.

    A fold that has no forecast of an item on its first days up to the horizon gives nulls, and ``fault`` says so.
    """
    grid = F.array(*[F.lit(float(q)) for q in levels])
    asked = requests.join(sums, ["item_id", "fold", "horizon"], "left")
    asked = asked.withColumn("k", F.size(F.filter(grid, lambda q: q <= F.col("critical_ratio"))) - 1)
    low = F.get(grid, F.col("k"))
    asked = asked.withColumn("w", F.coalesce(F.try_divide(F.col("critical_ratio") - low, F.get(grid, F.col("k") + 1) - low), F.lit(0.0)))
    good = F.col("fault").isNull() & F.col("sums").isNotNull()
    asked = asked.withColumns({"order": _at("sums", F.col("k"), F.col("w")), "spent": _at("priced", F.col("k"), F.col("w"))})
    over = (1 - F.col("margin")) * (F.col("spoilage") + F.col("holding"))
    parts = [F.lit(m) * F.when(F.lit(i) <= F.col("k"), (F.col("spent") - F.get("priced", F.lit(i))) * over).otherwise((F.get("priced", F.lit(i)) - F.col("spent")) * F.col("margin")) for i, m in enumerate(bin_masses(levels))]
    only = lambda c: F.when(good, c)
    fault = F.when(F.col("fault").isNull() & F.col("sums").isNull(), "no forecast").otherwise(F.col("fault"))
    return asked.select(*requests.drop("fault").columns, fault.alias("fault"), only(F.col("n_stores")).alias("n_stores"), only(F.col("order")).alias("order_qty"), only(F.col("demand")).alias("demand"), only(sum(parts[1:], parts[0])).alias("expected_cost"))


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """The rows that a report asks for: a value, a list of them, a pair of bounds as a tuple, or a beginning that ends in ``*``.

    A filter that is None asks for everything; one of an unknown column is an error.
    """
    for name, value in wanted.items():
        if name not in rows.columns:
            raise ValueError(f"unknown filter {name}; there are {', '.join(sorted(rows.columns))}")
        if value is None:
            continue
        column = F.col(name)
        if isinstance(value, tuple):
            rows = rows.where(column.between(*value))
        elif isinstance(value, list):
            rows = rows.where(column.isin(value))
        elif isinstance(value, str) and value.endswith("*"):
            rows = rows.where(column.startswith(value[:-1]))
        else:
            rows = rows.where(column == value)
    return rows
