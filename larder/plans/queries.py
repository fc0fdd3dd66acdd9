"""The registered queries over the demand model."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schema as S
from larder.functions.costs import CostModel
from larder.operators import boosting, demand, models, ordering, service
from larder.operators import forecasting as fc
from larder.operators import hierarchy as tree
from larder.plans.oracles import ORACLES  # noqa: F401
from larder.sources.files import newest
from larder.sources.rules import default_rules
from larder.sources.stored import fingerprint, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SOURCES = ("lineitem", "part", "supplier", "nation", "region")


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by: list[str], sort: list[str]) -> DataFrame:
    """A table made once of the tables of sales, bucketed."""
    return stored(spark, name, [f"{sf_dir}/{t}.parquet" for t in SOURCES], build, by, sort)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "daily", lambda: demand.daily_sales(*(table(spark, sf_dir, t) for t in SOURCES)), demand.SERIES, [*demand.SERIES, "date"])


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "panel", lambda: demand.fact_sales(daily(spark, sf_dir)), demand.SERIES, [*demand.SERIES, "date"])


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units at all levels of the tree."""
    return _stored(spark, sf_dir, "levels", lambda: tree.roll_up(fact(spark, sf_dir), ["units"]), ["node"], ["node", "date"])


def rounded(df: DataFrame, places: int = 6, exact: tuple[str, ...] = ("price",)) -> DataFrame:
    """Doubles to ``places``: sums in another order differ in the last bits. A price is one division of whole numbers, and stays."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes))


@query
def fact_sales(spark, sf_dir):
    return fact(spark, sf_dir)


@query
def panel_summary(spark, sf_dir):
    return rounded(demand.summary(fact(spark, sf_dir)))


def _days(spark, sf_dir):
    """Every day of the data, a row each."""
    days = lambda: demand.densify(daily(spark, sf_dir).withColumn("all", F.lit(1)), ["all"]).select("date")
    return stored(spark, "days", [f"{sf_dir}/{t}.parquet" for t in SOURCES], days)


@query
def dim_calendar(spark, sf_dir):
    return demand.calendar(_days(spark, sf_dir))


@query
def calendar_features(spark, sf_dir):
    return demand.event_distances(demand.calendar(_days(spark, sf_dir))).select("date", "event", "days_since_event", "days_to_event")


@query
def unpivot_sales(spark, sf_dir):
    """All days: wide tables of a year each, as a wide table of every day has more columns than a plan should."""
    panel = fact(spark, sf_dir)
    first, last = panel.agg(F.year(F.min("date")), F.year(F.max("date"))).first()
    if first is None:
        return demand.unpivot_sales(demand.wide_sales(panel, ["2000-01-01"]), ["item_id", "dept_id", "store_id"])
    years = []
    for year in range(first, last + 1):
        days = [str(date(year, 1, 1) + timedelta(days=i)) for i in range(366) if (date(year, 1, 1) + timedelta(days=i)).year == year]
        years.append(demand.unpivot_sales(demand.wide_sales(panel.where(F.year("date") == year), days), ["item_id", "dept_id", "store_id"]))
    return functools.reduce(DataFrame.unionByName, years)


def strata(spark, sf_dir):
    return demand.strata(demand.intermittency(fact(spark, sf_dir)))


@query
def item_stratum(spark, sf_dir):
    return rounded(strata(spark, sf_dir))


@query
def stratum_summary(spark, sf_dir):
    return rounded(demand.stratum_summary(strata(spark, sf_dir)))


@query
def stratified_sample(spark, sf_dir):
    return rounded(demand.sample(strata(spark, sf_dir), 4))


@query
def sample_shortfall(spark, sf_dir):
    return demand.shortfall(strata(spark, sf_dir), 7)


@query
def first_listed(spark, sf_dir):
    return demand.first_listed(fact(spark, sf_dir))


@query
def feature_panel(spark, sf_dir):
    return rounded(demand.features(fact(spark, sf_dir)))


@query
def null_shares(spark, sf_dir):
    return rounded(demand.null_shares(demand.features(fact(spark, sf_dir))))


@query
def folds(spark, sf_dir):
    return fc.folds(fact(spark, sf_dir))


def _naive(spark, sf_dir):
    panel = fact(spark, sf_dir)
    return panel, fc.folds(panel), fc.seasonal_naive(panel, fc.folds(panel))


@query
def seasonal_naive(spark, sf_dir):
    return _naive(spark, sf_dir)[2]


@query
def tsb_forecast(spark, sf_dir):
    panel, cut, _ = _naive(spark, sf_dir)
    return rounded(fc.tsb(panel, cut))


@query
def croston_forecast(spark, sf_dir):
    panel, cut, _ = _naive(spark, sf_dir)
    return rounded(fc.croston(panel, cut))


@query
def naive_scales(spark, sf_dir):
    panel, cut, _ = _naive(spark, sf_dir)
    return rounded(fc.naive_scales(panel, cut))


def _scored(spark, sf_dir, by=(), banded=False):
    panel, cut, naive = _naive(spark, sf_dir)
    both = naive.unionByName(fc.tsb(panel, cut))
    return fc.score(both, panel, fc.naive_scales(panel, cut), by, strata(spark, sf_dir) if banded else None)


@query
def fold_metrics(spark, sf_dir):
    return rounded(_scored(spark, sf_dir))


@query
def metrics_by_horizon(spark, sf_dir):
    return rounded(_scored(spark, sf_dir, ["horizon"]))


@query
def metrics_by_stratum(spark, sf_dir):
    return rounded(_scored(spark, sf_dir, ["stratum"], banded=True))


@query
def horizon_decay(spark, sf_dir):
    week = F.floor((F.col("horizon") - 1) / 7) + 1
    return rounded(_scored(spark, sf_dir, ["horizon"]).groupBy("model_name", "metric", week.alias("week")).agg(F.avg("value").alias("value")))


@query
def fold_summary(spark, sf_dir):
    return fc.across_folds(_scored(spark, sf_dir))


def _quantiles(spark, sf_dir):
    panel, cut, naive = _naive(spark, sf_dir)
    return panel, fc.quantile_forecast(naive, fc.residual_quantiles(panel, cut))


def _crossed(spark, sf_dir):
    """Quantiles that cross on some days, as separately fitted ones do."""
    _, rows = _quantiles(spark, sf_dir)
    return rows.withColumn("yhat", F.col("yhat") * F.when((F.col("quantile") == 0.75) & (F.col("horizon") % 4 == 0), 1.5).otherwise(1.0))


@query
def quantile_forecast(spark, sf_dir):
    return rounded(_quantiles(spark, sf_dir)[1])


@query
def monotone_quantiles(spark, sf_dir):
    return rounded(fc.monotone(_crossed(spark, sf_dir)))


@query
def crossing_rate(spark, sf_dir):
    return rounded(fc.crossing_rate(_crossed(spark, sf_dir)))


@query
def pinball_scores(spark, sf_dir):
    panel, rows = _quantiles(spark, sf_dir)
    return rounded(fc.pinball(rows, panel))


@query
def hybrid_forecast(spark, sf_dir):
    panel, cut, naive = _naive(spark, sf_dir)
    return rounded(fc.hybrid(naive.unionByName(fc.tsb(panel, cut)), strata(spark, sf_dir)))


COSTS = CostModel()


def _panel(spark, sf_dir):
    panel, cut, naive = _naive(spark, sf_dir)
    rows = fc.quantile_arrays(naive, fc.residual_quantiles(panel, cut))
    return panel, ordering.array_panel(fc.monotone_arrays(rows), panel)


def _money(df):
    """Sums of money to 2 places, others to 6."""
    coarse = {"understock_cost", "waste_cost", "holding_cost", "total_cost"}
    return df.select(*(F.round(c, 2 if c in coarse else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query
def order_policy(spark, sf_dir):
    out = ordering.order_policy(_panel(spark, sf_dir)[1], COSTS)
    return rounded(out.drop("expected_cost"), exact=("price", "cu", "co"))


@query
def money_table(spark, sf_dir):
    panel, wide = _panel(spark, sf_dir)
    return _money(ordering.money_table(wide, panel, COSTS))


@query
def cost_sensitivity(spark, sf_dir):
    panel, wide = _panel(spark, sf_dir)
    return _money(ordering.sensitivity(wide, panel, COSTS))


@query
def attribution(spark, sf_dir):
    panel, wide = _panel(spark, sf_dir)
    return _money(ordering.attribution(wide, panel, COSTS))


@query
def service_level_sweep(spark, sf_dir):
    return _money(ordering.sweep(_panel(spark, sf_dir)[1]))


@query
def optimize_item(spark, sf_dir):
    out = ordering.optimize_item(ordering.order_policy(_panel(spark, sf_dir)[1], COSTS), "Brand#1")
    return out.withColumns({"order_qty": F.round("order_qty", 4), "expected_cost": F.round("expected_cost", 2)})


@query
def hierarchy_actuals(spark, sf_dir):
    return rolled(spark, sf_dir)


@query
def hierarchy_weights(spark, sf_dir):
    return rounded(tree.weights(fact(spark, sf_dir)))


def _mixed(spark, sf_dir):
    """Forecasts at all levels that don't add up: smoothed demand of each series, last week's sums above."""
    panel, cut, _ = _naive(spark, sf_dir)
    upper = fc.seasonal_naive(rolled(spark, sf_dir).where("level <> 'item'"), cut, ["node", "level"])
    lower = fc.tsb(panel, cut)
    lower = lower.join(panel.select(*tree.PATH).distinct().select(F.concat_ws("/", *tree.PATH).alias("node"), "item_id", "store_id"), ["item_id", "store_id"]).withColumn("level", F.lit("item"))
    columns = ["node", "level", F.lit("mixed").alias("model_name"), "fold", "target_date", "yhat"]
    return upper.select(*columns).unionByName(lower.select(*columns))


def _base(spark, sf_dir):
    """The panel, its folds and the stored base forecasts."""
    panel = fact(spark, sf_dir)
    return panel, fc.folds(panel), _stored(spark, sf_dir, "base", lambda: _mixed(spark, sf_dir), ["node"], ["node", "fold", "target_date"])


@query
def mint_reconcile(spark, sf_dir):
    return rounded(tree.reconcile(_base(spark, sf_dir)[2]))


@query
def coherence_gap(spark, sf_dir):
    rows = tree.reconcile(_base(spark, sf_dir)[2])
    both = tree.coherence(rows).withColumn("reconciled", F.lit(False)).unionByName(tree.coherence(rows, "reconciled").withColumn("reconciled", F.lit(True)))
    return both.withColumns({"mean_abs_gap": F.round("mean_abs_gap", 4), "max_abs_gap": F.round("max_abs_gap", 4)})


def _whole_base(spark, sf_dir):
    """Smoothed departments, stores and states, and each series' demand if it was listed at the origin; 0 for those that were not."""

    def build():
        panel, sums = fact(spark, sf_dir), rolled(spark, sf_dir)
        cut = fc.folds(panel)
        upper = models.ets(sums.where("level <> 'item'"), _fold_list(panel), (0.5,), keys=["node", "level"])
        named = panel.groupBy(*tree.PATH).agg(F.min(F.when(F.col("price").isNotNull(), F.col("date"))).alias("listed")).select(F.concat_ws("/", *tree.PATH).alias("node"), "item_id", "store_id", "listed")
        lower = fc.tsb(panel, cut).join(named, ["item_id", "store_id"]).where("listed <= origin_date")
        columns = ["node", "fold", "target_date", "yhat"]
        return tree.whole_base(upper.select(*columns).unionByName(lower.select(*columns)), sums.select("node", "level").distinct(), fc.targets(cut))

    return _stored(spark, sf_dir, "whole_base", build, ["node"], ["node", "fold", "target_date"])


@query
def base_forecasts(spark, sf_dir):
    return rounded(_whole_base(spark, sf_dir))


@query
def reconciled_base(spark, sf_dir):
    """Whole base forecasts made to add up, those of unlisted series with them."""
    return rounded(tree.reconcile(_whole_base(spark, sf_dir), keys=["fold", "target_date"]))


def _node_scores(spark, sf_dir):
    panel, cut, base = _base(spark, sf_dir)
    rows = tree.reconcile(base).select("node", "level", "fold", "target_date", F.explode(F.array(F.struct(F.lit("base").alias("model_name"), F.col("yhat")), F.struct(F.lit("reconciled").alias("model_name"), F.col("reconciled").alias("yhat")))).alias("x"))
    rows = rows.select("node", "level", "fold", "target_date", "x.model_name", "x.yhat")
    actual = rolled(spark, sf_dir)
    scales = fc.naive_scales(actual, cut, ["node", "level"])
    errors = fc.errors(rows, actual, ["node", "level"])
    one = errors.groupBy("node", "level", "fold", "model_name").agg(F.avg(F.col("error") * F.col("error")).alias("mse")).join(scales, ["node", "level", "fold"], "left")
    return panel, one.withColumn("rmsse", F.sqrt(F.try_divide("mse", "scale_sq")))


@query
def wrmsse(spark, sf_dir):
    panel, scores = _node_scores(spark, sf_dir)
    return rounded(tree.wrmsse(scores, tree.weights(panel)))


@query
def level_comparison(spark, sf_dir):
    two = _node_scores(spark, sf_dir)[1].groupBy("level").pivot("model_name", ["base", "reconciled"]).agg(F.avg("rmsse"))
    delta = F.col("reconciled") - F.col("base")
    return rounded(two.withColumns({"delta": delta, "verdict": F.when(delta < 0, "better").when(delta > 0, "worse").otherwise("equal")}))


@query
def hierarchy_tree(spark, sf_dir):
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    items = lambda d: text(d["items"], lambda i: F.concat_ws(":", i["item_id"], i["units"].cast("string")))
    depts = F.array_join(F.transform("depts", lambda d: F.concat(d["dept_id"], F.lit(":"), d["units"].cast("string"), F.lit("("), items(d), F.lit(")"))), ";")
    return tree.tree(fact(spark, sf_dir)).withColumn("depts", depts)


# Service ----------------------------------------------------------------------------------------------------------------

AHEAD = 14


def _upload(spark, sf_dir):
    """Two histories in one file, all text: events by type, 30 days long, and sales by brand."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("Product"), F.col("ts").cast("date").cast("string").alias("Day"), F.col("value").cast("string").alias("Qty"), F.lit(None).cast("string").alias("Price"))
    brands = daily(spark, sf_dir).select(F.col("item_id").alias("Product"), F.col("date").cast("string").alias("Day"), F.col("units").cast("string").alias("Qty"), (F.col("cents") / 100 / F.col("units")).cast("string").alias("Price"))
    return events.unionByName(brands)


def _brands(spark, sf_dir):
    return service.daily(service.usable(service.parse_upload(_upload(spark, sf_dir))))


@query
def gate_verdicts(spark, sf_dir):
    return service.gate(_upload(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", "; "))


@query
def gate_report(spark, sf_dir):
    return service.gate_report(_upload(spark, sf_dir))


@query
def daily_densify(spark, sf_dir):
    return rounded(service.daily(service.usable(service.parse_upload(_upload(spark, sf_dir)))))


@query
def origin_features(spark, sf_dir):
    return rounded(service.origin_features(_brands(spark, sf_dir)))


@query
def total_ahead(spark, sf_dir):
    return rounded(service.strided(service.total_ahead(_brands(spark, sf_dir), AHEAD), AHEAD))


@query
def baseline_totals(spark, sf_dir):
    out = service.baseline_totals(_brands(spark, sf_dir), AHEAD, S.LEVELS)
    return rounded(out.select("sku", F.posexplode("quantiles").alias("k", "value")))


@query
def service_orders(spark, sf_dir):
    parsed = service.parse_upload(_upload(spark, sf_dir))
    prices = service.resolve_price(parsed.groupBy("sku", "date").agg(F.max("unit_price").alias("unit_price")))
    return rounded(service.order_quantities(service.baseline_totals(_brands(spark, sf_dir), AHEAD, S.LEVELS), prices, COSTS, S.LEVELS).withColumn("expected_cost", F.round("expected_cost", 2)), exact=("price",))


@query
def resolve_price(spark, sf_dir):
    return service.resolve_price(service.parse_upload(_upload(spark, sf_dir)).groupBy("sku", "date").agg(F.max("unit_price").alias("unit_price")))


@query
def choose_method(spark, sf_dir):
    """Mean pinball loss of the hybrid's two sources, for each item."""
    panel, cut, naive = _naive(spark, sf_dir)
    rows = fc.errors(naive.unionByName(fc.tsb(panel, cut)), panel)
    loss = F.greatest(F.lit(COSTS.critical_ratio()) * -F.col("error"), F.lit(COSTS.critical_ratio() - 1) * -F.col("error"))
    one = rows.groupBy(F.col("item_id").alias("sku")).agg(F.avg(F.when(F.col("model_name") == "tsb", loss)).alias("model"), F.avg(F.when(F.col("model_name") == "seasonal_naive", loss)).alias("baseline"))
    return rounded(service.choose_method(one))


@query
def fold_counts(spark, sf_dir):
    days = service.gate(_upload(spark, sf_dir)).select("sku", "n_days", service.fold_count(F.col("n_days"), AHEAD).alias("n_folds"))
    return days.withColumn("caveat", service.fold_caveat(F.col("n_folds")))


def _festivals(spark, sf_dir):
    days = _days(spark, sf_dir)
    return days, service.festivals(days.select(F.year("date").alias("year")).distinct())


@query
def festival_windows(spark, sf_dir):
    days, feasts = _festivals(spark, sf_dir)
    return service.active(days, feasts)


@query
def festival_proximity(spark, sf_dir):
    days, feasts = _festivals(spark, sf_dir)
    return service.proximity(days, feasts)


@query
def festival_uplift(spark, sf_dir):
    _, feasts = _festivals(spark, sf_dir)
    return rounded(service.uplift(service.occurrences(_brands(spark, sf_dir), feasts)))


# Names of products for the keyword rules, beside the brands, which no rule knows.
NAMES = ["Amul Milk 1L", "Plum Cake 500g", "Oil Lamp brass", "Holi Colours (gift pack)", "Chicken eggs", "National Flag, paper flag", "Dry Fruit Box 1kg", "soft drinks 2x", "Dates & milk", "unknown"]


def _skus(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sku")).distinct()
    return names.unionByName(spark.createDataFrame([(x,) for x in NAMES], "sku string"))


@query
def keyword_match(spark, sf_dir):
    return service.keyword_matches(_skus(spark, sf_dir), default_rules(spark))


@query
def keyword_coverage(spark, sf_dir):
    skus = _skus(spark, sf_dir)
    out = service.keyword_coverage(skus, service.keyword_matches(skus, default_rules(spark)))
    return out.withColumn("festivals", F.array_join("festivals", ","))


@query
def festival_plan(spark, sf_dir):
    """Plans of all brands for the days from 10 December 2000 on, by what their own sales say of earlier years."""
    _, feasts = _festivals(spark, sf_dir)
    history = _brands(spark, sf_dir).where("date <= date'2000-12-10'")
    effects = service.uplift(service.occurrences(history, feasts)).select("sku", "key", "multiplier")
    last = history.groupBy("sku").agg(F.max("date").alias("last"))
    return rounded(service.plan(last, feasts, effects, AHEAD))


@query
def festival_messages(spark, sf_dir):
    return service.plan_message(festival_plan(spark, sf_dir)).select("sku", "state", "message")


@query
def calendar_coverage(spark, sf_dir):
    _, feasts = _festivals(spark, sf_dir)
    return service.calendar_coverage(feasts, _brands(spark, sf_dir).groupBy("sku").agg(F.max("date").alias("last")), 60)


@query
def sku_backtest(spark, sf_dir):
    return rounded(service.sku_backtest(_brands(spark, sf_dir), AHEAD, COSTS.critical_ratio()))


@query
def retention(spark, sf_dir):
    """Orders stand for datasets: those of the last two years stay, and lines without them are counted."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("created"))
    kept = service.purge(orders, F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00")), 730)
    lost = service.orphans(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag"), kept, "o_orderkey")
    return lost.groupBy("l_returnflag").agg(F.count("*").alias("n_orphans"))


@query
def newest_rows(spark, sf_dir):
    return newest(fact(spark, sf_dir).groupBy("item_id", "date").agg(F.sum("units").alias("units")).where("units > 0"), ["item_id"], "date", 3)


@query
def latency_percentiles(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.percentile("value", F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)), F.max("value").alias("max"), F.count("*").alias("n")))


# Learned models: their rows are not for SQL to tell --------------------------------------------------------------------


def _fold_list(panel):
    return fc.checked_folds(panel)


@query
def ets_forecast(spark, sf_dir):
    panel = fact(spark, sf_dir)
    return rounded(models.ets(panel, _fold_list(panel)))


@query
def ets_selected(spark, sf_dir):
    """Smoothing in the form that each series asks for."""
    panel = fact(spark, sf_dir)
    return rounded(models.ets_selected(panel, _fold_list(panel)))


@query
def smoothing_forms(spark, sf_dir):
    """How many series of each fold take each form, and their mean AICc."""
    panel = fact(spark, sf_dir)
    rows = models.chosen_forms(panel, _fold_list(panel))
    return rounded(rows.groupBy("fold", "trend", "season").agg(F.count("*").alias("n_series"), F.avg("aicc").alias("mean_aicc")), 4)


def _assembled(spark, sf_dir):
    """The panel's folds, and its feature vectors, written for the passes of all fits."""
    panel = fact(spark, sf_dir)
    vectors = lambda: models.assembled(demand.features(panel)).select("date", *fc.SERIES, "units", "x")
    return _fold_list(panel), stored(spark, "vectors", [f"{sf_dir}/{t}.parquet" for t in SOURCES], vectors)


def _joined(parts):
    return functools.reduce(DataFrame.unionByName, parts)


#: Trees of each boosted model, their depth, and by how much a tree counts.
ROUNDS, DEPTH, RATE = 24, 4, 0.25
#: Training rows over which Shapley values are averaged.
SHAP_ROWS = 20_000
_FITS: dict[str, boosting.Boosted] = {}


def _boosted(spark, sf_dir) -> boosting.Boosted:
    """Models of every fold and level, and of every fold's mean, fitted once for an input in an application."""
    key = f"{spark.sparkContext.applicationId}/{fingerprint(spark, [f'{sf_dir}/{t}.parquet' for t in SOURCES])}"
    if key not in _FITS:
        panel = fact(spark, sf_dir)
        cut = _fold_list(panel)
        rows = models.with_means(demand.features(panel), cut[0][1])
        asked = [boosting.Model(fold, origin, q) for fold, origin in cut for q in (*S.LEVELS, None)]
        _FITS[key] = boosting.fit(rows, ["date", *fc.SERIES], models.BOOSTED_FEATURES, "units", asked, ROUNDS, DEPTH, RATE)
    return _FITS[key]


def _boosted_rows(spark, sf_dir):
    out = boosting.predictions(_boosted(spark, sf_dir), ["date", *fc.SERIES], S.HORIZON)
    return out.select(F.lit("boosted").alias("model_name"), "fold", "origin_date", F.col("date").alias("target_date"), F.datediff("date", "origin_date").alias("horizon"), *fc.SERIES, F.col("level").alias("quantile"), "yhat")


@query
def boosted_forecast(spark, sf_dir):
    """Quantiles by pinball loss, a model for each fold and level."""
    return rounded(_boosted_rows(spark, sf_dir).where("quantile is not null"))


@query
def boosted_point(spark, sf_dir):
    """The mean by Tweedie deviance, a model for each fold."""
    return rounded(_boosted_rows(spark, sf_dir).where("quantile is null").drop("quantile"))


@query
def boosted_crossings(spark, sf_dir):
    """How often separately fitted levels cross."""
    return rounded(fc.crossing_rate(_boosted_rows(spark, sf_dir).where("quantile is not null")))


def _forest(spark, sf_dir):
    cut, rows = _assembled(spark, sf_dir)
    return rows, [(fold, *models.forest(rows, origin)) for fold, origin in cut]


@query
def forest_forecast(spark, sf_dir):
    return rounded(_joined(out.withColumn("fold", F.lit(fold)) for fold, out, _ in _forest(spark, sf_dir)[1]))


def _importance(spark, sf_dir):
    fitted = _boosted(spark, sf_dir)
    return boosting.importance(fitted, [m for m, model in enumerate(fitted.models) if model.level is None], SHAP_ROWS, S.SEED)


@query
def feature_importance(spark, sf_dir):
    """Of every fold's model of the mean: gain, number of splits, and mean size of Shapley values over a sample of its training rows."""
    return rounded(_importance(spark, sf_dir))


@query
def top_features(spark, sf_dir):
    """The twelve greatest by Shapley values in the latest fold."""
    rows = _importance(spark, sf_dir).where("method = 'shap_mean_abs'")
    latest = rows.agg(F.max("fold").alias("latest"))
    return rounded(rows.join(F.broadcast(latest), F.col("fold") == F.col("latest")).drop("latest").orderBy(F.desc("value"), "feature").limit(12))  # one row


@query
def hybrid_learned(spark, sf_dir):
    """Quantiles by band: dense and middling items from boosted trees, sparse ones from smoothing; values sorted over levels."""
    panel = fact(spark, sf_dir)
    smooth = models.ets(panel, _fold_list(panel))
    both = smooth.unionByName(_boosted_rows(spark, sf_dir).where("quantile is not null"))
    routed = fc.hybrid(both, strata(spark, sf_dir).select("item_id", "stratum_name"), {"dense": "boosted", "mid": "boosted", "sparse": "ets"})
    return rounded(fc.monotone(routed))


@query
def model_backtest(spark, sf_dir):
    """Pinball loss of boosted trees, of the hybrid and of the baseline, on the same folds and levels."""
    panel, base = _quantiles(spark, sf_dir)
    learned = [x.select(*base.columns) for x in (hybrid_learned(spark, sf_dir), _boosted_rows(spark, sf_dir).where("quantile is not null"))]
    return rounded(fc.pinball(_joined([base, *learned]), panel))


def sku_fit(key, rows):
    """The smoothed total ahead of one product, and the deviation of its errors."""
    seen = rows.sort_values("date")["units_sold"].dropna().to_numpy(float)
    if len(seen) < 60:
        raise ValueError(f"60 recorded days needed, {len(seen)} found")
    path, sigma, _ = models.smooth(seen, [len(seen)], AHEAD)[0]
    return pd.DataFrame([{"total": max(0.0, float(path.sum())), "sigma": float(sigma[0])}])


@query
def sku_jobs(spark, sf_dir):
    """A fit of each product on its own; one that fails leaves a row that says why, and the others go on."""
    days = service.daily(service.usable(service.parse_upload(_upload(spark, sf_dir))))
    return rounded(days.groupBy("sku").applyInPandas(models.isolated(sku_fit, ["total", "sigma"]), "sku string, status string, error string, total double, sigma double"))
