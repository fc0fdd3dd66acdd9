"""Records and reports of the service: what is known of a festival, results by product, charts, warnings, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators import service

# What travels with an event; other properties are dropped.
ALLOWED = ("k",)


def resolve_uplift(pairs: DataFrame, measured: DataFrame, priors: DataFrame) -> DataFrame:
    """For each product and festival (sku, key, prior_only) the multiplier to use and where it comes from: measured, else a rule, else none.

    Festivals that only rules speak of take no measurement. ``measured``: sku, key, multiplier, years. ``priors``: sku, festival_key,
    keyword, category, multiplier.
    """
    own = measured.select(F.col("sku").alias("s"), F.col("key").alias("k"), F.col("multiplier").alias("seen"), "years")
    rule = priors.select(F.col("sku").alias("ps"), F.col("festival_key").alias("pk"), "keyword", "category", F.col("multiplier").alias("said"))
    rows = pairs.join(own, (F.col("sku") == F.col("s")) & (F.col("key") == F.col("k")) & ~F.col("prior_only"), "left")
    rows = rows.join(rule, (F.col("sku") == F.col("ps")) & (F.col("key") == F.col("pk")), "left")
    source = F.when(F.col("seen").isNotNull(), "measured").when(F.col("said").isNotNull(), "prior").otherwise("unavailable")
    text = F.when(F.col("seen").isNotNull(), F.format_string("Its own sales ran at %s of their usual level before %s, over %d year(s).", F.format_number("seen", 2), "key", "years")).when(
        F.col("said").isNotNull(), F.format_string("The rule for %s (keyword %s) says %s; its own sales do not tell.", "category", "keyword", F.format_number("said", 2))).otherwise(
        F.format_string("Nothing is known of %s for this product.", "key"))
    return rows.select("sku", "key", F.coalesce("seen", "said").alias("multiplier"), source.alias("source"), F.when(F.col("seen").isNull(), F.col("keyword")).alias("keyword"), text.alias("sentence"))


def result_rows(backtests: DataFrame, orders: DataFrame) -> DataFrame:
    """One record for each ordered product: number of folds, finite means and half the range over folds of each loss, method and status.

    Losses count in whole millionths and are divided once, halves up: no order of summation changes a record.
    """
    whole = lambda c: F.round(F.when(~F.isnan(c), F.col(c)) * 1_000_000).cast("long")
    halves = lambda top, n: F.floor((2 * top + n) / (2 * n)) / F.lit(1e6)
    mean = lambda c: F.when(F.count(whole(c)) > 0, halves(F.sum(whole(c)), F.count(whole(c))))
    spread = lambda c: halves(F.max(whole(c)) - F.min(whole(c)), F.lit(2))
    one = backtests.groupBy("sku").agg(F.count("*").cast("int").alias("n_folds"), mean("mase").alias("mase"), mean("pinball").alias("pinball"), spread("mase").alias("mase_spread"), spread("pinball").alias("pinball_spread"))
    rows = orders.join(one, "sku", "left").withColumn("n_folds", F.coalesce("n_folds", F.lit(0)))
    status = F.when(F.col("order_qty").isNull(), "failed").otherwise("done")
    label = F.when(F.col("n_folds") == 0, "not measured").when(F.col("mase") < 1, "better than yesterday's value").otherwise("no better than yesterday's value")
    return rows.select("sku", "order_qty", "expected_cost", "n_folds", "mase", "pinball", "mase_spread", "pinball_spread", label.alias("method_label"), status.alias("status"))


def chart_series(series: DataFrame, quantiles: DataFrame, tail: int, value: str = "units_sold") -> DataFrame:
    """What a chart shows of each product: its last ``tail`` days as text, oldest first, and low, middle and high of the total ahead."""
    last = series.withColumn("back", F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("date")))).where(F.col("back") <= tail)
    point = F.concat_ws(":", F.col("date").cast("string"), F.coalesce(F.round(value, 2).cast("decimal(20,2)").cast("string"), F.lit("-")))
    days = last.groupBy("sku").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", point.alias("p")))), lambda x: x["p"]), ",").alias("history"), F.count("*").alias("n_days"))
    band = quantiles.select("sku", F.col("quantiles")[0].alias("low"), F.col("quantiles")[2].alias("middle"), F.col("quantiles")[4].alias("high"))
    return days.join(band, "sku", "left")


def gate_warnings(raw: DataFrame) -> DataFrame:
    """Warnings on an uploaded file, one row each, and whether it can be used at all: kind, n, message, usable."""
    report = service.gate_report(raw)
    admitted = service.gate(raw).agg(F.count_if("admitted").alias("admitted"))
    votes = service.date_votes(raw).select(F.when(F.col("mixed"), F.least("n_day_first", "n_month_first")).otherwise(0).alias("n_mixed"), F.when(F.col("ambiguous"), F.col("n_either")).otherwise(0).alias("n_ambiguous"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("n"), F.lit(t).alias("t")) for k, c, t in (
        ("mixed", "n_mixed", "date(s) are written with the day and the month the other way round than most"), ("ambiguous", "n_ambiguous", "date(s) could be read day first or month first, and nothing in the file tells which"),
        ("dates", "rows_without_date", "row(s) without a readable date were left out"), ("merged", "rows_merged", "row(s) of a day that another row has too were added up"),
        ("negative", "negative_units", "negative amount(s) were read as 0"))])
    rows = report.crossJoin(F.broadcast(admitted)).crossJoin(F.broadcast(votes)).withColumn("x", F.explode(kinds))  # one row each
    usable = F.col("fatal").isNull() & (F.col("admitted") > 0)
    return rows.select("x.kind", "x.n", F.when(F.col("x.n") > 0, F.concat_ws(" ", F.col("x.n").cast("string"), "x.t")).alias("message"), usable.alias("usable"))


def worst_rejected(verdicts: DataFrame, n: int = 5) -> DataFrame:
    """Refused products, shortest history first."""
    return verdicts.where("not admitted").orderBy("n_days", "sku").limit(n)


def placed(rows: DataFrame, order: Sequence[str | Column], scratch: str) -> DataFrame:
    """All rows with their ``place``, 1 first: sorted in ranges, each of which starts after the number of rows before it.

    ``scratch``: where the ranges are written, so that they stay as they are.
    """
    ranged = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged.write.parquet(scratch)
    ranged = rows.sparkSession.read.schema(ranged.schema).parquet(scratch)
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("range").alias("r"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    out = ranged.join(F.broadcast(before), F.col("range") == F.col("r"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return out.withColumn("place", place.cast("int")).drop("range", "r", "before")


def ranked(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Rows with their ``place``, 1 first, among those of equal keys."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def supervised(series: DataFrame, horizon: int, value: str = "units_sold", folds: int = 0) -> DataFrame:
    """A row for each origin and day ahead: what is known at the origin, the calendar of the target day, and what was sold on it."""
    origins = service.strided(service.origin_features(series, value), horizon, folds=folds)
    ahead = origins.withColumnRenamed("date", "origin_date").withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("date", F.date_add("origin_date", F.col("horizon")))
    target = series.where(F.col(value).isNotNull()).select("sku", "date", F.col(value).alias("y"))
    rows = ahead.drop(value).join(target, ["sku", "date"]).withColumnRenamed("date", "target_date")
    return rows.withColumns(day_features(F.col("target_date")))


def day_features(day: Column) -> dict[str, Column]:
    """Monday is 0."""
    return {"day_of_week": F.weekday(day), "day_of_month": F.dayofmonth(day), "month": F.month(day), "is_weekend": (F.weekday(day) >= 5).cast("int")}


def baseline_daily(series: DataFrame, horizon: int, levels: Sequence[float], value: str = "units_sold") -> DataFrame:
    """Quantiles of each day ahead: the last recorded week again, plus quantiles of the change over seven recorded days; at least 0."""
    w = Window.partitionBy("sku").orderBy("date")
    seen = series.where(F.col(value).isNotNull()).select("sku", "date", F.col(value).cast("double").alias("v"))
    seen = seen.withColumns({"residual": F.col("v") - F.lag("v", 7).over(w), "back": F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("date")))})
    one = seen.groupBy("sku").agg(
        F.percentile("residual", F.array(*[F.lit(q) for q in levels])).alias("offsets"), F.max("date").alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("back") <= 7, F.struct((-F.col("back")).alias("n"), "v")))).alias("week"))
    one = one.where((F.size("week") == 7) & F.col("offsets").isNotNull())
    grid = F.arrays_zip(F.array(*[F.lit(q) for q in levels]).alias("quantile"), F.col("offsets").alias("o"))
    rows = one.select("sku", "week", grid.alias("grid"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon")).withColumn("x", F.explode("grid"))
    return rows.select("sku", "horizon", F.col("x.quantile").alias("quantile"), F.greatest(F.lit(0.0), F.col("week")[(F.col("horizon") - 1) % 7]["v"] + F.col("x.o")).alias("value"))


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents in ``gone`` and without what hangs on them."""
    left = parents.join(gone.select(key), key, "left_anti")
    return left, children.join(left.select(key), key, "left_semi")


def allowed_properties(json: Column, names: Sequence[str] = ALLOWED) -> Column:
    """Of a JSON object the properties that may be kept."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: k.isin(*names) & v.isNotNull())


def host(url: Column) -> Column:
    """The host of an address, without a leading www; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
