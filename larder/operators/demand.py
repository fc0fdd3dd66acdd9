"""From transactions to a dense daily panel, its strata, a sample of items, and leakage-free features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import schema as S

SERIES = ["item_id", "store_id"]


def daily_sales(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """date, item_id, store_id, units and cents (revenue). Stores follow from a supplier's region, items from a part's brand."""
    stores = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("store_id"))
    sold = lineitem.select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    sold = sold.join(part.select("p_partkey", F.col("p_brand").alias("item_id")), F.col("l_partkey") == F.col("p_partkey")).join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
    return sold.groupBy("date", *SERIES).agg(F.sum("l_quantity").cast("int").alias("units"), F.sum("cents").alias("cents"))


def department(item: Column) -> Column:
    """Five brands to a department."""
    return F.concat(F.lit("DEPT_"), (F.floor((F.regexp_extract(item, r"(\d+)$", 1).cast("int") - 1) / 5) + 1).cast("string"))


def event_name(date: Column) -> Column:
    day = F.date_format(date, "MM-dd")
    out = F.when(F.lit(False), F.lit(""))
    for k, v in S.EVENTS.items():
        out = out.when(day == k, F.lit(v))
    return out


def densify(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every observed key on every day between the first and last date: keys and date. A key unfolds its days where it stands."""
    bounds = rows.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return rows.select(*keys).distinct().crossJoin(F.broadcast(bounds)).select(*keys, F.explode(F.sequence("lo", "hi")).alias("date"))  # one row


def fact_sales(daily: DataFrame) -> DataFrame:
    """The dense panel: units 0 on days without a sale; the price is the week's revenue per unit, null in a week without sales."""
    week = F.date_trunc("week", "date").cast("date")
    price = daily.groupBy(*SERIES, week.alias("week")).agg((F.sum("cents") / (F.sum("units") * F.lit(100.0))).alias("price"))
    grid = densify(daily, SERIES).withColumn("week", week)
    out = grid.join(daily.select("date", *SERIES, "units"), ["date", *SERIES], "left").join(price, [*SERIES, "week"], "left")
    return out.select(
        "date", *SERIES, department(F.col("item_id")).alias("dept_id"), F.lit("ALL").alias("cat_id"), F.lit("ALL").alias("state_id"), F.coalesce("units", F.lit(0)).alias("units"), "price",
        (F.dayofmonth("date") <= 10).cast("int").alias("snap"), event_name(F.col("date")).alias("event"),
    )


def calendar(days: DataFrame) -> DataFrame:
    """One row a day. ``wday`` counts from Saturday, 1."""
    return days.select("date").distinct().select(
        "date", (F.dayofweek("date") % 7 + 1).alias("wday"), F.date_format("date", "EEEE").alias("weekday"), F.month("date").alias("month"), F.year("date").alias("year"),
        F.weekofyear("date").alias("week_of_year"), (F.dayofweek("date") % 7 + 1).isin(1, 2).alias("is_weekend"), event_name(F.col("date")).alias("event"), (F.dayofmonth("date") <= 10).cast("int").alias("snap"),
    )


def event_distances(calendar: DataFrame) -> DataFrame:
    """Days since the last event and to the next one, the day itself included: one pass over a running maximum and minimum."""
    event = F.when(F.col("event").isNotNull(), F.col("date"))
    back, on = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)  # one row a day
    return calendar.withColumns({"days_since_event": F.datediff("date", F.max(event).over(back)), "days_to_event": F.datediff(F.min(event).over(on), "date")})


def wide_sales(fact: DataFrame, days: Sequence[str]) -> DataFrame:
    """A column of units for each named day (yyyy-MM-dd), as uploads come."""
    return fact.groupBy("item_id", "dept_id", "store_id").pivot("date", list(days)).agg(F.sum("units"))


def unpivot_sales(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Wide to long; empty cells are dropped."""
    days = [c for c in wide.columns if c not in ids]
    return wide.unpivot(list(ids), days, "d", "units").where("units is not null")


def summary(fact: DataFrame) -> DataFrame:
    rows = fact.agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.struct(*SERIES)).alias("n_series"), F.count_distinct("item_id").alias("n_items"), F.count_distinct("store_id").alias("n_stores"),
        F.count_distinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg(F.when(F.col("units") == 0, 1.0).otherwise(0.0)).alias("zero_share"), F.avg(F.when(F.col("price").isNull(), 1.0).otherwise(0.0)).alias("unpriced_share"),
    )
    return rows.withColumn("rectangular", F.col("n_rows") == F.col("n_series") * F.col("n_dates"))


def intermittency(fact: DataFrame) -> DataFrame:
    """Zero share of each item over the window before the backtest, of items with a price in it."""
    last = fact.agg(F.max("date").alias("last"))
    inside = fact.crossJoin(F.broadcast(last)).where(F.col("date").between(F.date_sub("last", S.BACKTEST_DAYS + S.STRATIFY_DAYS - 1), F.date_sub("last", S.BACKTEST_DAYS)))  # one row
    return inside.groupBy("item_id", "dept_id").agg(F.avg(F.when(F.col("units") == 0, 1.0).otherwise(0.0)).alias("zero_share"), F.max("price").alias("p")).where("p is not null").drop("p")


def strata(items: DataFrame, n: int = len(S.STRATA)) -> DataFrame:
    """Bands of equal size within each department, densest first."""
    out = items.withColumn("stratum", F.ntile(n).over(Window.partitionBy("dept_id").orderBy("zero_share", "item_id")))
    name = F.when(F.lit(False), F.lit(""))
    for i, x in enumerate(S.STRATA, 1):
        name = name.when(F.col("stratum") == i, F.lit(x))
    return out.withColumn("stratum_name", name.otherwise(F.col("stratum").cast("string")))


def stratum_summary(strata: DataFrame) -> DataFrame:
    return strata.groupBy("dept_id", "stratum").agg(F.count("*").alias("n_items"), F.min("zero_share").alias("min_zero_share"), F.avg("zero_share").alias("avg_zero_share"), F.max("zero_share").alias("max_zero_share"))


def sample(strata: DataFrame, per_dept: int, n: int = len(S.STRATA), seed: int = S.SEED) -> DataFrame:
    """``per_dept`` items of each department, an equal quota of each band, by hash order; short departments are topped up from the rest."""
    quota, more = divmod(per_dept, n)
    order = F.md5(F.concat("item_id", F.lit(f"#{seed}")))
    ranked = strata.withColumn("pick", F.row_number().over(Window.partitionBy("dept_id", "stratum").orderBy(order, "item_id")))
    ranked = ranked.withColumn("chosen", F.col("pick") <= F.when(F.col("stratum") <= more, quota + 1).otherwise(quota))
    own = Window.partitionBy("dept_id")
    ranked = ranked.withColumn("short", F.lit(per_dept) - F.count_if("chosen").over(own))
    ranked = ranked.withColumn("extra", F.when(~F.col("chosen"), F.row_number().over(Window.partitionBy("dept_id", "chosen").orderBy(order, "item_id"))))
    return ranked.where("chosen or extra <= short").select("dept_id", "stratum", "item_id", "zero_share", (~F.col("chosen")).alias("topped_up"))


def shortfall(strata: DataFrame, per_dept: int) -> DataFrame:
    return strata.groupBy("dept_id").agg((F.lit(per_dept) - F.count("*")).alias("shortfall")).where("shortfall > 0")


def first_listed(fact: DataFrame) -> DataFrame:
    return fact.where("price is not null").groupBy(*SERIES).agg(F.min("date").alias("first_listed_date"))


def features(fact: DataFrame, horizon: int = S.HORIZON) -> DataFrame:
    """Lags, rolling figures, calendar and price of every listed series day; nothing of units is younger than ``horizon`` days.

    All windows share one partitioning by series, so there is one shuffle; rows before the first listing go afterwards.
    """
    w = Window.partitionBy(*SERIES).orderBy("date")
    sold = F.when(F.col("units") > 0, F.col("date"))
    # Spark adds to one running buffer from the start, while it sums a sliding frame anew for each row: so sums of frames are differences
    # of running sums, which are whole numbers and exact
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    u = F.col("units").cast("long")
    fact = fact.withColumns({"_n": F.row_number().over(w), "_s": F.sum(u).over(run), "_q": F.sum(u * u).over(run), "_z": F.count_if(u == 0).over(run)})
    columns: dict[str, Column] = {f"units_lag_{k}": F.lag("units", horizon + k).over(w) for k in S.LAGS}
    frame_sum = lambda c, n: F.lag(c, horizon).over(w) - F.coalesce(F.lag(c, horizon + n).over(w), F.lit(0))
    for n in S.WINDOWS:
        many = F.least(F.lit(n), F.col("_n") - horizon)
        s, q = frame_sum("_s", n), frame_sum("_q", n)
        columns |= {f"units_roll_mean_{n}": F.when(many > 0, s / many), f"units_roll_std_{n}": F.when(many > 1, F.sqrt((many * q - s * s) / (many * (many - 1))))}
        columns[f"units_roll_max_{n}"] = F.max("units").over(w.rowsBetween(-(horizon + n - 1), -horizon))
    columns["zero_share_90"] = F.when(F.col("_n") > horizon, frame_sum("_z", 90) / F.least(F.lit(90), F.col("_n") - horizon))
    columns["days_since_last_sale"] = F.datediff("date", F.max(sold).over(w.rowsBetween(Window.unboundedPreceding, -horizon))) - horizon
    columns["price_rel_28"] = F.try_divide("price", F.avg("price").over(w.rowsBetween(-27, 0)))
    columns["price_changed"] = ~F.col("price").eqNullSafe(F.lag("price", 1).over(w))
    columns["is_listed"] = F.col("price").isNotNull()
    columns["first_listed_date"] = F.min(F.when(F.col("price").isNotNull(), F.col("date"))).over(Window.partitionBy(*SERIES))
    out = fact.withColumns(columns).where("date >= first_listed_date").drop("first_listed_date", "snap", "event", "_n", "_s", "_q", "_z")
    days = event_distances(calendar(densify(fact, ["state_id"]).select("date")))
    return out.join(F.broadcast(days), "date").withColumn("horizon", F.lit(horizon))  # one row a day


def null_shares(features: DataFrame) -> DataFrame:
    """Share of nulls of each feature, in one pass."""
    names = [c for c in features.columns if c.startswith(("units_", "zero_", "days_", "price_"))]
    one = features.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names))
    return one.unpivot([], names, "feature", "null_share")
