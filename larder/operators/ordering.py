"""From quantile forecasts to orders, their simulated cost, and comparisons of policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import schema as S
from larder.functions.costs import FALLBACK_PRICE, CostModel, bracket, expected_cost, interpolate
from larder.operators.forecasting import SERIES, wide_quantiles


def level_columns(levels: Sequence[float] = S.LEVELS) -> list[Column]:
    return [F.col(f"`{q}`") for q in levels]


def _actuals(fact: DataFrame) -> DataFrame:
    return fact.select(*SERIES, F.col("date").alias("target_date"), F.col("units").cast("double").alias("demand"), F.coalesce("price", F.lit(FALLBACK_PRICE)).alias("price"))


def quantile_panel(monotone: DataFrame, fact: DataFrame, levels: Sequence[float] = S.LEVELS) -> DataFrame:
    """A row for each forecast day: a column for each level, demand, and price (a fixed one where none is known)."""
    return wide_quantiles(monotone, levels).join(_actuals(fact), [*SERIES, "target_date"])


def array_panel(rows: DataFrame, fact: DataFrame, levels: Sequence[float] = S.LEVELS) -> DataFrame:
    """The same of forecasts that hold all levels of a row in an array (``values``, sorted): no group and no pivot."""
    wide = rows.select("model_name", "fold", *SERIES, "target_date", "horizon", *(F.col("values")[i].alias(str(q)) for i, q in enumerate(levels)))
    return wide.join(_actuals(fact), [*SERIES, "target_date"])


def order_policy(panel: DataFrame, costs: CostModel) -> DataFrame:
    """The order at the critical ratio, with its costs."""
    ratio = costs.critical_ratio()
    quantity = F.greatest(F.lit(0.0), interpolate(S.LEVELS, level_columns(), ratio))
    expected = expected_cost(S.LEVELS, level_columns(), F.col("order_qty"), F.col("cu"), F.col("co"))
    out = panel.withColumns({"cu": costs.under(F.col("price")), "co": costs.over(F.col("price")), "critical_ratio": F.lit(ratio), "order_qty": quantity})
    return out.withColumn("expected_cost", expected).select("model_name", "fold", *SERIES, "target_date", "price", "cu", "co", "critical_ratio", "order_qty", "demand", "expected_cost")


def simulate(orders: DataFrame, costs: CostModel, by: Sequence[str] = ("policy",)) -> DataFrame:
    """Cost of orders against demand, over all rows: stockout share, units short and left, cost by kind."""
    short, left = F.greatest(F.col("demand") - F.col("q"), F.lit(0.0)), F.greatest(F.col("q") - F.col("demand"), F.lit(0.0))
    price = F.col("price")
    out = orders.groupBy(*by).agg(
        F.avg((short > 0).cast("double")).alias("stockout_rate"), F.sum(short).alias("units_short"), F.sum(left).alias("units_left"), F.sum(short * costs.under(price)).alias("understock_cost"),
        F.sum(left * costs.unit(price) * F.lit(costs.spoilage)).alias("waste_cost"), F.sum(left * costs.unit(price) * F.lit(costs.holding)).alias("holding_cost"), F.count("*").alias("n_rows"),
    )
    return out.withColumn("total_cost", F.col("understock_cost") + F.col("waste_cost") + F.col("holding_cost"))


def naive_orders(fact: DataFrame) -> DataFrame:
    """What was sold seven days before the target day."""
    return fact.select(*SERIES, F.date_add("date", 7).alias("target_date"), F.col("units").cast("double").alias("naive"))


def _stacked(panel: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """A row for each policy, in one pass over the panel."""
    both = F.array(*[F.struct(F.lit(k).alias("policy"), v.cast("double").alias("q")) for k, v in policies.items()])
    return panel.select("demand", "price", F.explode(both).alias("x")).select("x.policy", "x.q", "demand", "price")


def policies(panel: DataFrame, fact: DataFrame, costs: CostModel) -> DataFrame:
    rows = panel.join(naive_orders(fact), [*SERIES, "target_date"], "left").withColumn("naive", F.coalesce("naive", F.lit(0.0)))
    newsvendor = F.greatest(F.lit(0.0), interpolate(S.LEVELS, level_columns(), costs.critical_ratio()))
    return _stacked(rows, {"naive": F.col("naive"), "fixed_95": F.col("`0.95`"), "newsvendor": newsvendor})


def money_table(panel: DataFrame, fact: DataFrame, costs: CostModel) -> DataFrame:
    out = simulate(policies(panel, fact, costs), costs)
    naive = out.where("policy = 'naive'").select(F.col("total_cost").alias("naive_cost"))
    out = out.crossJoin(F.broadcast(naive))  # one row
    return out.withColumn("saving_vs_naive", F.try_divide(F.col("naive_cost") - F.col("total_cost"), "naive_cost")).drop("naive_cost")


def sensitivity(panel: DataFrame, fact: DataFrame, base: CostModel, spoilages: Sequence[float] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """The money table at several spoilage shares, in one pass; a ratio outside the grid gives a null order and cost."""
    rows = panel.join(naive_orders(fact), [*SERIES, "target_date"], "left").withColumn("naive", F.coalesce("naive", F.lit(0.0)))
    cells = []
    for s in spoilages:
        costs = CostModel(base.margin, s, base.holding)
        ratio = costs.critical_ratio()
        inside = S.LEVELS[0] <= ratio <= S.LEVELS[-1]
        order = F.greatest(F.lit(0.0), interpolate(S.LEVELS, level_columns(), ratio)) if inside else F.lit(None).cast("double")
        for name, q in (("naive", F.col("naive")), ("fixed_95", F.col("`0.95`")), ("newsvendor", order)):
            cells.append(F.struct(F.lit(s).alias("spoilage"), F.lit(ratio).alias("critical_ratio"), F.lit(name).alias("policy"), q.cast("double").alias("q")))
    x = rows.select("demand", "price", F.explode(F.array(*cells)).alias("x")).select("x.*", "demand", "price")
    short, left = F.greatest(F.col("demand") - F.col("q"), F.lit(0.0)), F.greatest(F.col("q") - F.col("demand"), F.lit(0.0))
    cost = short * base.under(F.col("price")) + left * base.unit(F.col("price")) * (F.col("spoilage") + F.lit(base.holding))
    out = x.groupBy("spoilage", "policy").agg(F.max("critical_ratio").alias("critical_ratio"), F.sum(F.when(F.col("q").isNotNull(), cost)).alias("total_cost"))
    naive = out.where("policy = 'naive'").select("spoilage", F.col("total_cost").alias("naive_cost"))
    return out.join(naive, "spoilage").withColumn("saving_vs_naive", F.try_divide(F.col("naive_cost") - F.col("total_cost"), "naive_cost")).drop("naive_cost")


def attribution(panel: DataFrame, fact: DataFrame, costs: CostModel) -> DataFrame:
    """Forecast and ordering rule apart: last week's sale or the model's median, ordered as it is or moved to the critical ratio.

    Last week's sale has no distribution; it is moved by the mean ratio of the model's order to its median.
    """
    rows = panel.join(naive_orders(fact), [*SERIES, "target_date"], "left").withColumn("naive", F.coalesce("naive", F.lit(0.0)))
    rows = rows.withColumn("order_qty", F.greatest(F.lit(0.0), interpolate(S.LEVELS, level_columns(), costs.critical_ratio())))
    ratio = rows.agg((F.avg(F.col("order_qty") + 1e-9) / F.avg(F.col("`0.5`") + 1e-9)).alias("ratio"))
    rows = rows.crossJoin(F.broadcast(ratio))  # one row
    cells = {"naive|as_forecast": F.col("naive"), "naive|newsvendor": F.col("naive") * F.col("ratio"), "model|as_forecast": F.col("`0.5`"), "model|newsvendor": F.col("order_qty")}
    out = simulate(_stacked(rows, cells), costs)
    worst = out.agg(F.max("total_cost").alias("worst"))
    out = out.crossJoin(F.broadcast(worst))  # one row
    return out.select(F.split("policy", r"\|")[0].alias("forecast"), F.split("policy", r"\|")[1].alias("rule"), "total_cost", F.try_divide(F.col("worst") - F.col("total_cost"), "worst").alias("saving_vs_worst"))


def sweep(panel: DataFrame, ratios: Sequence[float] = tuple(round(0.1 + i / 100, 2) for i in range(90))) -> DataFrame:
    """Units short and left and stockout share at each service level: the panel is expanded inside the task and summed before it moves."""
    # each ratio between two levels: the lower one's place, and how far it is towards the next
    cells = []
    for r in ratios:
        i, w = bracket(S.LEVELS, r)
        cells.append(f"named_struct('r', {r!r}D, 'i', {i}, 'w', {w!r}D)")
    grid = F.expr(f"transform(array({', '.join(cells)}), x -> named_struct('critical_ratio', x.r, 'q', v[x.i] + x.w * (v[least(x.i + 1, {len(S.LEVELS) - 1})] - v[x.i])))")
    rows = panel.select("demand", F.array(*level_columns()).alias("v")).select("demand", F.explode(grid).alias("x")).select("demand", "x.*")
    short, left = F.greatest(F.col("demand") - F.col("q"), F.lit(0.0)), F.greatest(F.col("q") - F.col("demand"), F.lit(0.0))
    return rows.groupBy("critical_ratio").agg(F.sum(short).alias("units_short"), F.sum(left).alias("units_left"), F.avg((short > 0).cast("double")).alias("stockout_rate"))


def optimize_item(policy: DataFrame, item: str) -> DataFrame:
    """One item's orders of the latest fold, summed over stores."""
    own = policy.where(F.col("item_id") == item)
    latest = own.agg(F.max("fold").alias("latest"))
    rows = own.join(F.broadcast(latest), F.col("fold") == F.col("latest"))  # one row
    return rows.groupBy("item_id", "target_date").agg(F.sum("order_qty").alias("order_qty"), F.sum("demand").alias("demand"), F.sum("expected_cost").alias("expected_cost"), F.count("*").alias("n_stores"))


def forecast_item(forecasts: DataFrame, item: str) -> DataFrame:
    """One item's forecast of the latest fold, summed over stores."""
    own = forecasts.where(F.col("item_id") == item)
    latest = own.agg(F.max("fold").alias("latest"))
    rows = own.join(F.broadcast(latest), F.col("fold") == F.col("latest"))  # one row
    return rows.groupBy("item_id", "target_date", "horizon").agg(F.sum("yhat").alias("yhat"), F.count("*").alias("n_stores"))


__all__ = ["array_panel", "attribution", "forecast_item", "level_columns", "money_table", "naive_orders", "optimize_item", "order_policy", "policies", "quantile_panel", "sensitivity", "simulate", "sweep"]
