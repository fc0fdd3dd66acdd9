"""A learned model of each product, by day and for the whole window, its backtest beside the baseline, and the forecast that wins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.costs import CostModel
from larder.operators import boosting, results, service

SHORT, LONG = 7, 91
# Days and windows without which no model is fitted.
MIN_DAYS, MIN_TOTALS = 60, 24


def learning_rows(series: DataFrame, horizon: int, value: str = "units_sold") -> DataFrame:
    """A row for each recorded day: v, weekday, rising (the short mean is above the long one), before (so it was a horizon earlier, which a
    forecast of this day may know), total (of the next ``horizon`` recorded days), ends (the last of them) and change (from the recorded day
    before, of days after the first sale)."""
    w = Window.partitionBy("sku").orderBy("date")
    mean = lambda n: F.round(F.avg("v").over(w.rowsBetween(-(n - 1), 0)), 6)
    ahead = w.rowsBetween(1, horizon)
    rows = series.where(F.col(value).isNotNull()).select("sku", "date", F.col(value).cast("double").alias("v"))
    rows = rows.withColumns({"weekday": F.weekday("date"), "rising": mean(SHORT) > mean(LONG), "total": F.when(F.count("v").over(ahead) == horizon, F.sum("v").over(ahead)), "ends": F.lead("date", horizon).over(w)})
    first = F.min(F.when(F.col("v") > 0, F.col("date"))).over(Window.partitionBy("sku"))
    rows = rows.withColumn("change", F.when(F.col("date") > first, F.abs(F.col("v") - F.lag("v").over(w))))
    return rows.withColumn("before", F.coalesce(F.lag("rising", horizon).over(w), F.lit(False)))


def learned(rows: DataFrame, origins: DataFrame, horizon: int, levels: Sequence[float], guarded: bool = True) -> tuple[DataFrame, DataFrame]:
    """Quantiles of each day ahead and of the whole window, for each product and fold of ``origins`` (sku, fold, origin_date).

    A leaf is a weekday and a trend, for totals a trend alone; its quantiles are those of the days in it up to the origin. A leaf without
    days takes those of all days; totals that end after the origin are not learned from. If ``guarded``, with fewer than ``MIN_DAYS`` days
    or ``MIN_TOTALS`` totals before the origin there is no model, and no row; else each product with a day has rows, and null totals where
    it has no window. (daily with the scale of its product and fold, totals)
    """
    rows = service.with_origins(rows, origins).withColumn("span", service.span(F.col("date")))
    mark = lambda kind, value, where, weekday, trend: F.struct(F.lit(kind).alias("kind"), where.alias("span"), value.alias("value"), weekday.alias("weekday"), trend.alias("trend"))
    none, no_trend = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    marks = [mark("day", F.col("v"), F.col("span"), F.col("weekday"), F.col("before")), mark("total", F.col("total"), service.span(F.col("ends")), none, F.col("rising")), mark("change", F.col("change"), F.col("span"), none, no_trend)]
    past = service.value_counts(rows, marks, ["weekday", "trend"], F.max("date").alias("last"), F.max_by("rising", "date").alias("rising"))
    grid = F.array(*[F.lit(q) for q in levels])
    of = lambda kind, c="value": F.when(F.col("kind") == kind, F.col(c))
    one = past.groupBy("sku", "fold", "origin_date").agg(
        F.percentile(of("day"), grid, F.col("n")).alias("whole"), F.percentile(of("total"), grid, F.col("n")).alias("whole_total"), F.max_by("rising", of("day", "last")).alias("before"),
        F.try_divide(F.sum(of("change") * F.col("n")), F.sum(of("change", "n"))).alias("scale"), F.sum(of("day", "n")).alias("n_days"), F.sum(of("total", "n")).alias("n_totals"))
    if guarded:
        one = one.where((F.col("n_days") >= MIN_DAYS) & (F.col("n_totals") >= MIN_TOTALS))
    one = one.drop("n_days", "n_totals")
    leaves = past.where("kind = 'day'").groupBy("sku", "fold", "weekday", F.col("trend").alias("before")).agg(F.percentile("value", grid, F.col("n")).alias("leaf"))
    ahead = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("date", F.date_add("origin_date", F.col("h"))).withColumn("weekday", F.weekday("date"))
    daily = ahead.join(leaves, ["sku", "fold", "weekday", "before"], "left").select("sku", "fold", "origin_date", "date", "scale", F.coalesce("leaf", "whole").alias("quantiles"))
    own = past.where("kind = 'total'").groupBy("sku", "fold", F.col("trend").alias("before")).agg(F.percentile("value", grid, F.col("n")).alias("leaf"))
    totals = one.select("sku", "fold", "before", "whole_total").join(own, ["sku", "fold", "before"], "left")
    return daily, totals.select("sku", "fold", F.coalesce("leaf", "whole_total").alias("quantiles"))


def backtest(series: DataFrame, horizon: int, ratio: float) -> DataFrame:
    """The model's error on each product's folds: sku, fold, mae and mase (of the daily median) and pinball (of the total, at the ratio)."""
    q = round(ratio, 4)
    rows = learning_rows(series, horizon)
    daily, totals = learned(rows, service.sku_folds(series, horizon), horizon, (0.5, q))
    seen = daily.join(rows.select("sku", "date", "v"), ["sku", "date"]).groupBy("sku", "fold").agg(F.avg(F.abs(F.col("v") - F.col("quantiles")[0])).alias("mae"), F.max("scale").alias("scale"), F.sum("v").alias("realised"))
    gap = F.col("realised") - F.col("quantiles")[1]
    mase = F.when(F.col("scale") > 1e-12, F.col("mae") / F.col("scale"))
    return seen.join(totals, ["sku", "fold"], "left").select("sku", "fold", "mae", mase.alias("mase"), F.greatest(F.lit(q) * gap, F.lit(q - 1) * gap).alias("pinball"))


# What boosted trees of products know of an origin, and of a day ahead of it.
KNOWN = [*(f"lag_{k}" for k in service.LAGS), *(f"{f}_{n}" for n in service.WINDOWS for f in ("mean", "std", "zero")), "trend", "same_weekday_4"]
AHEAD = ["horizon", "day_of_week", "day_of_month", "month", "is_weekend"]


def boosted(series: DataFrame, horizon: int, levels: Sequence[float], folds: int = 5, rounds: int = 8, depth: int = 3, rate: float = 0.35, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Quantiles by boosted trees, of all products together and at two grains: each day ahead of a fold's origin, and the whole window.

    Products end on different days; they are laid side by side so that all end on one, and a fold's origin lies ``back`` windows before it.
    A fold learns from days, and from windows, that end by its origin. A product with fewer than ``MIN_DAYS`` days or ``MIN_TOTALS``
    windows to learn from has no row in that fold. (sku, back, date, y, quantiles), (sku, back, quantiles); quantiles sorted, at least 0.
    """
    ends = series.groupBy("sku").agg(F.max("date").alias("end"))
    last = ends.agg(F.max("end")).first()[0]
    if last is None:
        raise ValueError("no product has a day")
    models = [boosting.Model(b, last - timedelta(days=b * horizon), q) for b in range(1, folds + 1) for q in levels]
    shift = F.datediff(F.lit(last), "end")
    days = results.supervised(series, horizon, folds=folds).withColumnRenamed("origin_date", "known").withColumn("own", F.col("target_date"))
    wins = service.total_ahead(service.origin_features(series), horizon).withColumnRenamed("date", "known").withColumn("own", F.date_add("known", horizon))
    out = []
    for rows, names, least_rows in ((days, [*KNOWN, *AHEAD], MIN_DAYS), (wins, KNOWN, MIN_TOTALS)):
        rows = rows.join(ends, "sku").withColumns({"date": F.date_add("own", shift), "known": F.date_add("known", shift)})
        fitted = boosting.fit(rows, ["sku", "own", "known", "date"], names, "y", models, rounds, depth, rate, least)
        n = fitted.rows.where("y is not null").crossJoin(F.broadcast(rows.sparkSession.createDataFrame(sorted({(m.fold, m.last) for m in models}), "back int, until int"))).where("day <= until")  # a few folds
        enough = n.groupBy("sku", "back").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows).select("sku", "back")
        found = boosting.predictions(fitted, ["sku", "own", "known", "date"], horizon).where(F.col("known") == F.col("origin_date")).withColumnRenamed("fold", "back")
        found = found.groupBy("sku", "back", "own").agg(F.array_sort(F.collect_list("yhat")).alias("quantiles"))  # a level each
        out.append(found.join(enough, ["sku", "back"], "left_semi"))
    daily, totals = out
    both = daily.select("sku", "back").distinct().join(totals.select("sku", "back"), ["sku", "back"])
    seen = series.select("sku", F.col("date").alias("own"), F.col("units_sold").cast("double").alias("y"))
    daily = daily.join(seen, ["sku", "own"]).join(both, ["sku", "back"], "left_semi").select("sku", "back", F.col("own").alias("date"), "y", "quantiles")
    return daily, totals.join(both, ["sku", "back"], "left_semi").select("sku", "back", "quantiles")


def boosted_backtest(series: DataFrame, horizon: int, ratio: float, **settings) -> DataFrame:
    """The error of boosted trees on each product's folds, as ``backtest`` has it: sku, back, mae (of the daily median), pinball (of the total)."""
    q = round(ratio, 4)
    daily, totals = boosted(series, horizon, (0.5, q) if q > 0.5 else (q, 0.5), **settings)
    median, order = (0, 1) if q > 0.5 else (1, 0)
    seen = daily.where("y is not null").groupBy("sku", "back").agg(F.avg(F.abs(F.col("y") - F.col("quantiles")[median])).alias("mae"), F.sum("y").alias("realised"))
    gap = F.col("realised") - F.col("quantiles")[order]
    return seen.join(totals, ["sku", "back"]).select("sku", "back", "mae", F.greatest(F.lit(q) * gap, F.lit(q - 1) * gap).alias("pinball"))


def _sums(tests: DataFrame, name: str) -> DataFrame:
    """Losses in whole millionths, so that no order of summation changes a choice or its text."""
    whole = lambda c: F.floor(F.col(c) * 1_000_000 + 0.5)
    return tests.groupBy("sku").agg(F.sum(whole("pinball")).alias(f"{name}_p"), F.count("pinball").alias(f"{name}_n"), F.sum(whole("mase")).alias(f"{name}_m"), F.count("mase").alias(f"{name}_k"))


def _three(total: Column, n: Column) -> Column:
    """A mean of millionths with three places, halves up."""
    t = F.floor((2 * total + 1000 * n) / (2000 * n))
    return F.concat(F.floor(t / 1000).cast("string"), F.lit("."), F.lpad((t % 1000).cast("string"), 3, "0"))


def chosen(folds: DataFrame, model: DataFrame, baseline: DataFrame) -> DataFrame:
    """The method of each product (``folds``: sku, n_folds) by mean pinball loss over its folds, and a sentence with the figures.

    A product whose model could be fitted in no fold has the baseline, and so has one whose losses differ by less than the margin.
    """
    rows = folds.join(_sums(model, "m"), "sku", "left").join(_sums(baseline, "b"), "sku", "left")
    mean = lambda x: F.when(F.col(f"{x}_n") > 0, F.col(f"{x}_p") / (F.col(f"{x}_n") * F.lit(1e6)))
    rows = service.choose_method(rows.withColumns({"model": mean("m"), "baseline": mean("b")})).withColumn("code", F.col("reason"))
    mp, bp = _three(F.col("m_p"), F.col("m_n")), _three(F.col("b_p"), F.col("b_n"))
    day = lambda x: F.when(F.col(f"{x}_k") > 0, _three(F.col(f"{x}_m"), F.col(f"{x}_k"))).otherwise("unknown")
    n = F.least("m_n", "b_n")
    over = F.concat(F.lit(" over "), n.cast("string"), F.lit(" fold(s)"), F.when(n < F.col("n_folds"), F.concat(F.lit(" of "), F.col("n_folds").cast("string"), F.lit(", the others too early for a model"))).otherwise(""), F.lit("."))
    daily = F.concat(F.lit(" Daily error, scaled: model "), day("m"), F.lit(", repeated week "), day("b"), F.lit("."))
    turned = F.when((F.col("m_k") > 0) & (F.col("b_k") > 0) & (F.col("b_m") * F.col("m_k") < F.col("m_m") * F.col("b_k")), " Day by day the repeated week was closer; the loss of the order decides.").otherwise("")
    text = F.when(F.col("code") == service.NOT_FITTED, "No fold had enough history for a model, so the repeated week is used.").when(
        F.col("code") == service.CLOSE, F.concat(F.lit("Too close to call, so the simpler repeated week is used: order loss "), mp, F.lit(" by the model and "), bp, F.lit(" by the repeated week"), over, daily)).when(
        F.col("method") == "baseline", F.concat(F.lit("The repeated week orders better: loss "), bp, F.lit(" against "), mp, F.lit(" by the model"), over, daily)).otherwise(
        F.concat(F.lit("The model orders better: loss "), mp, F.lit(" against "), bp, F.lit(" by the repeated week"), over, daily, turned))
    measured = F.when(F.col("code") == service.NOT_FITTED, F.coalesce("b_n", F.lit(0))).otherwise(n)
    caveat = service.fold_caveat(measured)
    return rows.select("sku", "model", "baseline", "method", F.concat(text, F.coalesce(F.concat(F.lit(" "), caveat), F.lit(""))).alias("reason"))


def forecast(series: DataFrame, methods: DataFrame, prices: DataFrame, costs: CostModel, horizon: int, levels: Sequence[float], plans: DataFrame) -> DataFrame:
    """Each product's order from the distribution of its chosen method, fitted on its whole history, and moved by its festival plan
    (``plans``: sku, factor, state). The cost is that of the order as moved. A model that can't be fitted now gives way to the baseline."""
    rows = learning_rows(series, horizon)
    last = rows.groupBy("sku").agg(F.lit(0).alias("fold"), F.max("date").alias("origin_date"))
    fitted = learned(rows, last, horizon, levels)[1].select("sku", F.col("quantiles").alias("fitted"))
    both = service.baseline_totals(series, horizon, levels).join(fitted, "sku", "left").join(methods, "sku")
    method = F.when((F.col("method") == "model") & F.col("fitted").isNotNull(), "model").otherwise("baseline")
    both = both.withColumn("method", method)
    totals = both.select("sku", "method", "reason", F.when(F.col("method") == "model", F.col("fitted")).otherwise(F.col("quantiles")).alias("quantiles"))
    orders = service.order_quantities(totals.select("sku", "quantiles"), prices, costs, levels, plans)
    return orders.join(totals.select("sku", "method", "reason"), "sku").select("sku", "method", "reason", "price", "order_before", "factor", "state", "order_qty", "expected_cost")
