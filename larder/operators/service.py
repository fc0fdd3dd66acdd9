"""From an uploaded sales history to a plan for each product: gate, daily series, features, baseline, order, festivals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.almanac import moving_days
from larder.functions.costs import FALLBACK_PRICE, CostModel, expected_cost, interpolate

# Names that uploads use for a column, and the thresholds of the gate.
ALIASES = {
    "sku": ("sku", "product", "product_id", "item", "item_id"), "date": ("date", "day", "ds", "order_date", "sale_date"),
    "units_sold": ("units_sold", "units", "qty", "quantity", "sales", "demand", "y"), "unit_price": ("unit_price", "price", "sell_price", "selling_price"),
}
MIN_DAYS, MIN_OBSERVATIONS, MAX_GAP = 90, 20, 14
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd")
DAY_FIRST, MONTH_FIRST = ("dd/MM/yyyy", "dd-MM-yyyy"), ("MM/dd/yyyy", "MM-dd-yyyy")
# Lags and windows of the service's features, days of a festival's baseline and buffer, and least observations.
LAGS, WINDOWS = (1, 2, 3, 7, 14, 28), (7, 14, 28, 91)
BASELINE_DAYS, BUFFER_DAYS, MIN_BASELINE, MIN_LEAD = 28, 3, 6, 3
CLIP_DAYS, LOOKAHEAD, MATERIAL = 45, 14, 0.01
MARGIN = 0.05
#: Shorter keywords say nothing of a product.
MIN_KEYWORD = 3
#: What the gate says to a product that it refuses.
TOO_SHORT = f"its history spans %d days, under the least of {MIN_DAYS}"
TOO_FEW = f"%d days have an amount, under the least of {MIN_OBSERVATIONS}"
GAP_TOO_LONG = f"nothing was recorded for %d days on end, over the most of {MAX_GAP}"


def resolve_columns(columns: Sequence[str]) -> dict[str, str]:
    """Canonical names to the file's own; the first alias wins. A file without a needed column is an error that names what it has."""
    own = {c.strip().lower(): c for c in columns}
    found = {k: next(own[a] for a in names if a in own) for k, names in ALIASES.items() if any(a in own for a in names)}
    if missing := [k for k in ("sku", "date", "units_sold") if k not in found]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(columns) or 'none'}; accepted: {'; '.join(k + ': ' + '/'.join(ALIASES[k]) for k in missing)}")
    return found


def date_votes(raw: DataFrame) -> DataFrame:
    """One row on how a file writes its days: how many values only day first can read (a first part over 12), only month first, either,
    or neither; which order the file is read in (the one with more votes, day first if equal), whether both have votes (``mixed``), and
    whether none has and some value could be read both ways (``ambiguous``)."""
    text = F.trim(F.col(resolve_columns(raw.columns)["date"]).cast("string"))
    part = lambda n: F.expr(f"try_cast(regexp_extract(d, '^([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-][0-9]{{4}}$', {n}) as int)")
    rows = raw.select(text.alias("d")).withColumns({"a": part(1), "b": part(2)})
    two = F.col("a").between(1, 31) & F.col("b").between(1, 31)
    one = rows.agg(
        F.count_if(two & (F.col("a") > 12) & (F.col("b") <= 12)).alias("n_day_first"), F.count_if(two & (F.col("b") > 12) & (F.col("a") <= 12)).alias("n_month_first"),
        F.count_if(two & (F.col("a") <= 12) & (F.col("b") <= 12) & (F.col("a") != F.col("b"))).alias("n_either"), F.count_if(F.col("d").isNotNull() & ~F.coalesce(two, F.lit(False))).alias("n_other"))
    mixed = (F.col("n_day_first") > 0) & (F.col("n_month_first") > 0)
    return one.withColumns({"month_first": F.col("n_month_first") > F.col("n_day_first"), "mixed": mixed, "ambiguous": (F.col("n_day_first") + F.col("n_month_first") == 0) & (F.col("n_either") > 0)})


def parse_upload(raw: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """sku, date, units_sold, unit_price, all rows: what can't be read is null.

    A date with two parts before its year is read day first, or in the order that ``votes`` names for the whole file; a value that this
    order can't read is read in the other.
    """
    names = resolve_columns(raw.columns)
    text = F.col(names["date"]).cast("string")
    read = lambda formats: [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    day = F.coalesce(*read(DATE_FORMATS), *read(DAY_FIRST), *read(MONTH_FIRST))
    if votes is not None:
        day = F.when(F.col("_month_first"), F.coalesce(*read(DATE_FORMATS), *read(MONTH_FIRST), *read(DAY_FIRST))).otherwise(day)
        raw = raw.crossJoin(F.broadcast(votes.select(F.col("month_first").alias("_month_first"))))  # one row
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    price = number(names["unit_price"]) if "unit_price" in names else F.lit(None).cast("double")
    return raw.select(F.trim(F.col(names["sku"]).cast("string")).alias("sku"), day.alias("date"), number(names["units_sold"]).alias("units_sold"), price.alias("unit_price"))


def usable(parsed: DataFrame) -> DataFrame:
    """Rows with a product and a date; negative units count as 0."""
    rows = parsed.where("date is not null and sku is not null and sku <> ''")
    return rows.withColumn("units_sold", F.when(F.col("units_sold") < 0, 0.0).otherwise(F.col("units_sold")))


def merge_days(rows: DataFrame) -> DataFrame:
    """One row for each product and day; units are summed, and stay null where all are."""
    return rows.groupBy("sku", "date").agg(F.sum("units_sold").alias("units_sold"))


def gate(raw: DataFrame) -> DataFrame:
    """A verdict for each product, with every reason against it."""
    days = merge_days(usable(parse_upload(raw)))
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("sku").orderBy("date"))) - 1
    one = days.withColumn("gap", gap).groupBy("sku").agg(
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("n_days"), F.count("*").alias("n_obs"), F.count("units_sold").alias("n_nonnull"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_days"))
    blank = F.col("n_obs") - F.col("n_nonnull")
    rules = F.array(*[F.struct(broken.alias("broken"), text.alias("text")) for broken, text in (
        (F.col("n_days") < MIN_DAYS, F.format_string(TOO_SHORT, "n_days")),
        (F.col("n_nonnull") < MIN_OBSERVATIONS, F.format_string(TOO_FEW + "%s", "n_nonnull", F.when(blank == 0, "").otherwise(F.format_string(" (in %d rows)", "n_obs")))),
        (F.col("max_gap_days") > MAX_GAP, F.format_string(GAP_TOO_LONG, "max_gap_days")))])
    reasons = F.transform(F.filter(rules, lambda x: x["broken"]), lambda x: x["text"])
    return one.withColumns({"reasons": reasons, "admitted": ~F.exists(rules, lambda x: x["broken"])})


def gate_report(raw: DataFrame) -> DataFrame:
    """One row on the whole file: what was read, dropped, merged and clipped, and why it is refused as a whole, if it is."""
    parsed = parse_upload(raw)
    good = F.col("date").isNotNull() & F.col("sku").isNotNull() & (F.col("sku") != "")
    read = parsed.agg(F.count("*").alias("rows_read"), F.count_if(F.col("date").isNull()).alias("rows_without_date"), F.count_if(good).alias("rows_used"), F.count_if(good & (F.col("units_sold") < 0)).alias("negative_units"))
    merged = merge_days(usable(parsed)).agg(F.count("*").alias("n"))
    fatal = F.when(F.col("rows_read") == 0, "no rows").when(F.col("rows_without_date") > 0.5 * F.col("rows_read"), "most dates can't be read").when(F.col("rows_used") == 0, "no row has a product and a date")
    out = read.crossJoin(F.broadcast(merged))  # one row each
    return out.select("rows_read", "rows_without_date", "rows_used", "negative_units", (F.col("rows_used") - F.col("n")).alias("rows_merged"), fatal.alias("fatal"))


def daily(rows: DataFrame) -> DataFrame:
    """Every day between a product's first and last; days without a row are null."""
    days = merge_days(rows)
    span = days.groupBy("sku").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select("sku", F.explode(F.sequence("lo", "hi")).alias("date"))
    return span.join(days, ["sku", "date"], "left")


def origin_features(series: DataFrame, value: str = "units_sold") -> DataFrame:
    """What is known at each origin, its own day included."""
    w = Window.partitionBy("sku").orderBy("date")
    v = F.col(value).cast("double")
    out: dict[str, Column] = {f"lag_{k}": F.lag(v, k - 1).over(w) for k in LAGS}
    for n in WINDOWS:
        frame = w.rowsBetween(-(n - 1), 0)
        enough = F.count(v).over(frame) >= max(2, n // 4)
        out |= {f"mean_{n}": F.when(enough, F.avg(v).over(frame)), f"std_{n}": F.when(enough, F.stddev_samp(v).over(frame))}
        rows = F.count(F.lit(1)).over(frame) >= max(2, n // 4)  # here days count, and a day without a row is no zero
        out[f"zero_{n}"] = F.when(rows, F.avg(F.when(v == 0, 1.0).otherwise(0.0)).over(frame))
    out["trend"] = F.row_number().over(w) - 1
    same = Window.partitionBy("sku", F.dayofweek("date"), v.isNotNull()).orderBy("date").rowsBetween(-3, 0)
    out["same_weekday_4"] = F.when(v.isNotNull(), F.avg(v).over(same))
    return series.withColumns(out)


def total_ahead(series: DataFrame, horizon: int, value: str = "units_sold") -> DataFrame:
    """Sum of the next ``horizon`` days of each origin, if all of them are there."""
    frame = Window.partitionBy("sku").orderBy("date").rowsBetween(1, horizon)
    return series.withColumn("y", F.when(F.count(value).over(frame) == horizon, F.sum(value).over(frame)))


def strided(origins: DataFrame, horizon: int, most: int = 8000, folds: int = 0) -> DataFrame:
    """Every k-th origin of a product, counted from its last, so that there are at most ``most`` rows of training; the origins of
    ``folds`` folds, a horizon apart, stay too."""
    w = Window.partitionBy("sku")
    rows = origins.withColumns({"back": F.row_number().over(w.orderBy(F.desc("date"))) - 1, "n": F.count(F.lit(1)).over(w)})
    fold = (F.col("back") % horizon == 0) & F.col("back").between(horizon, folds * horizon)
    return rows.where((F.col("back") % F.greatest(F.ceil(F.col("n") * horizon / most), F.lit(1)) == 0) | fold).drop("back", "n")


def baseline_totals(series: DataFrame, horizon: int, levels: Sequence[float], value: str = "units_sold") -> DataFrame:
    """Quantiles of the sums over ``horizon`` observed days that a product has had; too short a history scales its mean."""
    seen = series.where(F.col(value).isNotNull())
    frame = Window.partitionBy("sku").orderBy("date").rowsBetween(0, horizon - 1)
    rows = seen.withColumns({"total": F.when(F.count(value).over(frame) == horizon, F.sum(value).over(frame).cast("double"))})
    one = rows.groupBy("sku").agg(F.percentile("total", F.array(*[F.lit(q) for q in levels])).alias("q"), F.avg(value).alias("mean"))
    flat = F.array_repeat(F.col("mean") * horizon, len(levels))
    return one.select("sku", F.transform(F.coalesce("q", flat), lambda x: F.greatest(x, F.lit(0.0))).alias("quantiles"))


def resolve_price(parsed: DataFrame) -> DataFrame:
    """The last positive price of each product, or the fixed one."""
    one = parsed.groupBy("sku").agg(F.max_by(F.when(F.col("unit_price") > 0, F.col("unit_price")), F.when(F.col("unit_price") > 0, F.col("date"))).alias("p"))
    return one.select("sku", F.coalesce("p", F.lit(FALLBACK_PRICE)).alias("price"), F.col("p").isNull().alias("assumed"))


def order_quantities(totals: DataFrame, prices: DataFrame, costs: CostModel, levels: Sequence[float], plans: DataFrame | None = None) -> DataFrame:
    """Order and expected cost of each product from the distribution of its total.

    With ``plans`` (sku, factor, state) the order is moved by the factor, and ``order_before`` is what it was.
    """
    values = [F.col("quantiles")[i] for i in range(len(levels))]
    rows = totals.join(prices, "sku", "left").withColumn("price", F.coalesce("price", F.lit(FALLBACK_PRICE)))
    rows = rows.withColumn("order_before", F.greatest(F.lit(0.0), interpolate(levels, values, costs.critical_ratio())))
    more = ["order_before", "factor", "state"] if plans is not None else []
    if plans is not None:
        rows = rows.join(plans.select("sku", "factor", "state"), "sku", "left").na.fill({"factor": 1.0, "state": "none"})
    rows = rows.withColumn("order_qty", F.col("order_before") * F.col("factor") if plans is not None else F.col("order_before"))
    return rows.select("sku", "price", *more, "order_qty", expected_cost(levels, values, F.col("order_qty"), costs.under(F.col("price")), costs.over(F.col("price"))).alias("expected_cost"))


def fold_count(n_days: Column, horizon: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(5), F.floor((n_days - 28) / horizon))).cast("int")


def fold_caveat(n_folds: Column) -> Column:
    """What to keep in mind where fewer than three folds were measured."""
    return F.when(n_folds <= 0, "Nothing could be measured on its own history.").when(n_folds == 1, "One fold alone was measured, which may be luck.").when(n_folds == 2, "Two folds alone were measured, so the figures are rough.")


NOT_FITTED, CLOSE = "the model could not be fitted", "too close to call"


def choose_method(scores: DataFrame) -> DataFrame:
    """The method with the lower loss; within the margin, or without a model's loss, the baseline. ``scores``: sku, model, baseline."""
    scale = F.greatest(F.abs("model"), F.abs("baseline"), F.lit(1e-9))
    close = F.abs(F.col("model") - F.col("baseline")) / scale < MARGIN
    method = F.when(F.col("model").isNull() | close | (F.col("baseline") < F.col("model")), "baseline").otherwise("model")
    reason = F.when(F.col("model").isNull(), NOT_FITTED).when(close, CLOSE).when(F.col("baseline") < F.col("model"), "the baseline was better").otherwise("the model was better")
    return scores.withColumns({"method": method, "reason": reason})


# Festivals ------------------------------------------------------------------------------------------------------------

# Festivals with a date of their own in every year: month, day, run-up days, days after, whether only rules speak of them.
FESTIVALS = {"christmas": ("Christmas", 12, 25, 10, 1, False), "independence_day": ("Independence Day", 8, 15, 3, 0, True), "republic_day": ("Republic Day", 1, 26, 2, 0, True)}


# Festivals of moving date: name, run-up days, days after. Their days follow from moon and sun.
MOVING = {"diwali": ("Diwali", 14, 2), "holi": ("Holi", 7, 1), "maha_shivaratri": ("Maha Shivratri", 5, 1), "raksha_bandhan": ("Raksha Bandhan", 5, 1), "eid_al_fitr": ("Eid al-Fitr", 7, 1)}
# Festivals of the other region: name, run-up days, days after.
US_FESTIVALS = {"thanksgiving": ("Thanksgiving", 7, 1), "christmas": ("Christmas", 10, 1), "super_bowl": ("Super Bowl", 3, 0)}


def _windows(days: DataFrame, table: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Festivals (key, day) with name, window_start, window_end, prior_only."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (n, a, b) in table.items()])
    x = days.withColumn("x", F.filter(rows, lambda r: r["k"] == F.col("key"))[0])
    return x.select("key", "x.name", "day", F.date_sub("day", F.col("x.a")).alias("window_start"), F.date_add("day", F.col("x.b")).alias("window_end"), F.lit(False).alias("prior_only"))


def us_festivals(years: DataFrame) -> DataFrame:
    """Festivals of the United States in each year: the fourth Thursday of November, the first Sunday of February, 25 December."""
    at = lambda m, d: F.make_date("year", F.lit(m), F.lit(d))
    rules = {"thanksgiving": F.date_add(F.next_day(at(10, 31), "Thu"), 21), "super_bowl": F.next_day(at(1, 31), "Sun"), "christmas": at(12, 25)}
    x = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), day.alias("day")) for k, day in rules.items()]))
    return _windows(years.select(x.alias("x")).select("x.*"), US_FESTIVALS)


def festivals(years: DataFrame) -> DataFrame:
    """key, name, day, window_start, window_end, prior_only for each year of ``years``; moving dates come from the almanac, for any year."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(p).alias("prior_only")) for k, (n, m, d, a, b, p) in FESTIVALS.items()])
    x = years.select("year", F.explode(rows).alias("x")).select("year", "x.*").withColumn("day", F.make_date("year", "m", "d"))
    fixed = x.select("key", "name", "day", F.date_sub("day", F.col("a")).alias("window_start"), F.date_add("day", F.col("b")).alias("window_end"), "prior_only")
    return fixed.unionByName(_windows(moving_days(years), MOVING))


def active(days: DataFrame, festivals: DataFrame) -> DataFrame:
    """The festival that owns a day: of those whose window holds it, the nearest; then one that can be measured; then by key."""
    rows = days.join(F.broadcast(festivals), F.col("date").between(F.col("window_start"), F.col("window_end")))  # a few a year
    best = F.struct(F.abs(F.datediff("date", "day")).alias("distance"), "prior_only", "key")
    return rows.groupBy("date").agg(F.min(best).alias("x")).select("date", "x.key", "x.distance")


def proximity(days: DataFrame, festivals: DataFrame) -> DataFrame:
    """Days to the next festival and since the last one, clipped, and whether a run-up is on: running minimum and maximum, no pairs."""
    marks = days.select("date", F.lit(None).cast("date").alias("day")).union(festivals.select(F.col("day").alias("date"), "day"))
    marks = marks.withColumn("n", F.unix_date("date"))  # one row a day
    ahead, back = Window.orderBy("n").rangeBetween(0, Window.unboundedFollowing), Window.orderBy("n").rangeBetween(Window.unboundedPreceding, 0)
    both = marks.withColumns({"next": F.min("day").over(ahead), "last": F.max("day").over(back)}).where("day is null")
    clip = lambda x: F.least(F.coalesce(x, F.lit(CLIP_DAYS)), F.lit(CLIP_DAYS))
    on = active(days, festivals).select("date", F.lit(1).alias("on"))
    return both.join(on, "date", "left").select("date", clip(F.datediff("next", "date")).alias("days_to_next"), clip(F.datediff("date", "last")).alias("days_since_last"), F.coalesce("on", F.lit(0)).alias("in_window"))


def occurrences(series: DataFrame, festivals: DataFrame, value: str = "units_sold") -> DataFrame:
    """Each festival of each product measured: run-up and day against nearby days of the same weekdays, if enough were recorded."""
    f = festivals.where("not prior_only").select("key", "name", "day", "window_start", "window_end")
    far = BUFFER_DAYS + BASELINE_DAYS
    rows = series.where(F.col(value).isNotNull()).select("sku", "date", F.col(value).cast("double").alias("v"))
    rows = rows.join(F.broadcast(f), F.col("date").between(F.date_sub("window_start", far), F.date_add("window_end", far)))  # a few a year
    lead, tail = (F.col("date") >= F.col("window_start")) & (F.col("date") < F.col("day")), F.col("date").between(F.col("day"), F.col("window_end"))
    rows = rows.withColumns({"lead": lead, "tail": tail, "dow": F.dayofweek("date")})
    own = Window.partitionBy("sku", "key", "day", "dow")
    outside = (F.col("date") < F.date_sub("window_start", BUFFER_DAYS)) | (F.col("date") > F.date_add("window_end", BUFFER_DAYS))
    rows = rows.withColumn("base", outside & F.bool_or("lead").over(own))
    mean = lambda c: F.avg(F.when(F.col(c), F.col("v")))
    one = rows.groupBy("sku", "key", "name", "day").agg(mean("lead").alias("lead_mean"), mean("tail").alias("day_mean"), mean("base").alias("baseline_mean"), F.count_if("lead").alias("n_lead"), F.count_if("base").alias("n_baseline"), F.count_if(F.col("tail") & (F.col("v") == 0)).alias("closed_days"))
    one = one.where((F.col("n_lead") >= MIN_LEAD) & (F.col("n_baseline") >= MIN_BASELINE) & (F.col("baseline_mean") > 0))
    return one.withColumns({"lead_ratio": F.col("lead_mean") / F.col("baseline_mean"), "day_ratio": F.col("day_mean") / F.col("baseline_mean")})


def uplift(occurrences: DataFrame) -> DataFrame:
    """A festival's effect on a product: median ratio over years, with its spread."""
    return occurrences.groupBy("sku", "key", "name").agg(F.median("lead_ratio").alias("multiplier"), F.min("lead_ratio").alias("low"), F.max("lead_ratio").alias("high"), F.count("*").alias("years"), (F.sum("closed_days") > 0).alias("shut_on_day"))


def tokens(text: Column) -> Column:
    """Words of a-z and 0-9 between spaces, one space at each end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def keyword_matches(skus: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that speaks for a product at each festival: the longest phrase in its name; none if equally long ones disagree.

    Rules: festival_key, direction, category, items (comma list), suggested_multiplier and ``row`` (their order). A phrase is looked up by
    the one of its words that fewest products have, an equal join, and then read in the names that have the word.
    """
    phrases = rules.select("row", "festival_key", "direction", "category", "suggested_multiplier", F.posexplode(F.split("items", ",")).alias("nth", "keyword"))
    phrases = phrases.withColumns({"keyword": F.trim("keyword"), "phrase": tokens(F.col("keyword"))}).where(F.char_length(F.trim("phrase")) >= MIN_KEYWORD)
    words = lambda c: F.array_distinct(F.split(F.trim(c), " "))
    names = skus.select("sku", tokens(F.col("sku")).alias("name"))
    index = names.select("sku", "name", F.explode(words("name")).alias("word"))
    often = index.groupBy("word").agg(F.count("*").alias("n"))
    texts = phrases.select("phrase").distinct().select("phrase", F.explode(words("phrase")).alias("word"))
    rarest = texts.join(often, "word", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("x")).where("x.n > 0").select("phrase", F.col("x.word").alias("word"))
    rows = index.join(phrases.join(rarest, "phrase"), "word").where(F.contains("name", "phrase"))
    size = F.char_length(F.replace("phrase", F.lit(" "), F.lit("")))
    best = Window.partitionBy("sku", "festival_key")
    rows = rows.withColumn("size", size).withColumn("top", F.max("size").over(best)).where("size = top")
    rows = rows.withColumns({"lo": F.min("direction").over(best), "hi": F.max("direction").over(best)}).where("lo = hi")
    return rows.groupBy("sku", "festival_key").agg(F.min(F.struct("row", "nth", "keyword", "category", "suggested_multiplier")).alias("x")).select("sku", "festival_key", "x.keyword", "x.category", F.col("x.suggested_multiplier").alias("multiplier"))


def keyword_coverage(skus: DataFrame, matches: DataFrame) -> DataFrame:
    """Festivals that have something to say about each product; products without any are kept."""
    return skus.select("sku").distinct().join(matches.groupBy("sku").agg(F.array_sort(F.collect_set("festival_key")).alias("festivals")), "sku", "left").withColumn("matched", F.col("festivals").isNotNull())


def plan(last_days: DataFrame, festivals: DataFrame, effects: DataFrame, horizon: int) -> DataFrame:
    """sku, factor, state: mean daily multiplier over the days ahead. A day in a run-up takes its nearest festival's effect, else 1.

    ``last_days``: sku, last. ``effects``: sku, key, multiplier. adjusted: an effect in the window; advisory: a festival near, but none
    with an effect; none: no festival near.
    """
    days = last_days.select("sku", "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("date", F.date_add("last", F.col("h")))
    known = festivals.join(effects, "key")
    on = days.join(known.withColumnRenamed("sku", "s"), (F.col("sku") == F.col("s")) & (F.col("date") >= F.col("window_start")) & (F.col("date") < F.col("day")))
    owner = F.struct(F.abs(F.datediff("date", "day")).alias("distance"), "prior_only", "key", "multiplier")
    owned = on.groupBy("sku", "date").agg(F.min(owner).alias("x")).select("sku", "date", "x.multiplier")
    rows = days.join(owned, ["sku", "date"], "left").groupBy("sku").agg(F.avg(F.coalesce("multiplier", F.lit(1.0))).alias("factor"), F.count("multiplier").alias("days_adjusted"))
    near = last_days.join(F.broadcast(festivals), (F.col("window_start") <= F.date_add("last", horizon + LOOKAHEAD)) & (F.col("window_end") > F.col("last"))).select("sku").distinct().withColumn("near", F.lit(True))  # a few a year
    state = F.when(F.col("days_adjusted") > 0, "adjusted").when(F.col("near"), "advisory").otherwise("none")
    return rows.join(near, "sku", "left").select("sku", "factor", "days_adjusted", state.alias("state"), (F.abs(F.col("factor") - 1) >= MATERIAL).alias("material"))


# Records --------------------------------------------------------------------------------------------------------------


def purge(datasets: DataFrame, now: Column, days: int) -> DataFrame:
    """Datasets that are younger than the retention."""
    if days <= 0:
        raise ValueError("retention must be positive")
    return datasets.where(F.col("created") >= now - F.make_dt_interval(F.lit(days)))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is gone."""
    return children.join(parents.select(key), key, "left_anti")


# Backtest of one product ------------------------------------------------------------------------------------------------


def sku_folds(series: DataFrame, horizon: int) -> DataFrame:
    """Folds of each product's own history: sku, fold, origin_date; products too short for any have none."""
    spans = series.groupBy("sku").agg(F.count("*").alias("n_days"), F.max("date").alias("last"))
    spans = spans.withColumn("n", fold_count(F.col("n_days"), horizon)).where("n > 0")
    folds = spans.select("sku", "last", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("fold"))
    return folds.select("sku", "fold", F.date_sub("last", ((F.col("n") - F.col("fold")) * horizon).cast("int")).alias("origin_date"))


def with_origins(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with the ``origins`` (origin_date, fold) of their product, in order; products without folds are left out."""
    own = folds.groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("origin_date", "fold"))).alias("origins"))  # a few folds
    return rows.join(own, "sku")


def span(day: Column) -> Column:
    """Where a day lies between the origins: how many of them come before it. The folds from that place on train on it."""
    return F.size(F.filter("origins", lambda o: o["origin_date"] < day))


def value_counts(rows: DataFrame, marks: Sequence[Column], by: Sequence[str], *more: Column) -> DataFrame:
    """Values of marks (structs of kind, span, value and ``by``), counted once for each span, then given to every fold that trains on it.

    ``rows`` have ``origins``. So a day is read once, and what folds get are counts of values: few where units are whole numbers, and
    never more than days. A row for each fold and counted value: sku, fold, origin_date, kind, value, ``by``, n, and the aggregates ``more``.
    """
    x = rows.withColumn("mark", F.explode(F.array(*marks))).where(F.col("mark.value").isNotNull() & (F.col("mark.span") < F.size("origins")))
    names = ["kind", "span", "value", *by]
    parts = x.select(*rows.columns, *(F.col(f"mark.{c}").alias(f"m_{c}") for c in names)).groupBy("sku", *(F.col(f"m_{c}").alias(c) for c in names)).agg(F.count("*").alias("n"), F.any_value("origins").alias("origins"), *more)
    kept = [c for c in parts.columns if c not in ("span", "origins")]
    each = parts.withColumn("o", F.explode(F.slice("origins", F.col("span") + 1, F.size("origins"))))
    return each.select(*kept, "o.fold", "o.origin_date")


def sku_backtest(series: DataFrame, horizon: int, ratio: float, value: str = "units_sold") -> DataFrame:
    """The baseline's error on each product's folds: sku, fold, mase (median path) and pinball (of the total, at the ratio).

    Days without a value are left out: the last week is the last seven recorded days, and sums run over recorded days.
    """
    w = Window.partitionBy("sku").orderBy("date")
    frame = w.rowsBetween(0, horizon - 1)
    seen = series.where(F.col(value).isNotNull()).select("sku", "date", F.col(value).cast("double").alias("v"))
    sold = F.min(F.when(F.col("v") > 0, F.col("date"))).over(Window.partitionBy("sku"))
    rows = seen.withColumns({
        "at": F.row_number().over(w), "residual": F.col("v") - F.lag("v", 7).over(w), "change": F.when(F.col("date") > sold, F.abs(F.col("v") - F.lag("v").over(w))),
        "total": F.when(F.count("v").over(frame) == horizon, F.sum("v").over(frame)), "ends": F.lead("date", horizon - 1).over(w)})
    rows = with_origins(rows, sku_folds(series, horizon)).withColumn("span", span(F.col("date")))
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy("sku", "span").orderBy(F.desc("date"))))
    mark = lambda kind, value, where=F.col("span"), at=None: F.struct(F.lit(kind).alias("kind"), where.alias("span"), value.alias("value"), F.lit(at).cast("int").alias("at"))
    week = F.struct(F.lit("week").alias("kind"), F.col("span"), F.when(F.col("back") <= 7, F.col("v")).alias("value"), F.col("at"))  # seven a span
    counts = value_counts(rows, [mark("residual", F.col("residual")), mark("change", F.col("change")), mark("total", F.col("total"), span(F.col("ends"))), week], ["at"])
    of = lambda kind, c="value": F.when(F.col("kind") == kind, F.col(c))
    one = counts.groupBy("sku", "fold", "origin_date").agg(
        F.percentile(of("residual"), F.lit(0.5), F.col("n")).alias("offset"), F.percentile(of("total"), F.lit(round(ratio, 4)), F.col("n")).alias("ordered"),
        F.try_divide(F.sum(of("change") * F.col("n")), F.sum(of("change", "n"))).alias("scale"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == "week", F.struct("at", F.col("value").alias("v"))))), -7, 7).alias("week"))
    one = one.where(F.size("week") == 7)
    ahead = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("date", F.date_add("origin_date", F.col("h")))
    ahead = ahead.withColumn("path", F.greatest(F.lit(0.0), F.col("week")[(F.col("h") - 1) % 7]["v"] + F.coalesce("offset", F.lit(0.0))))
    rows = ahead.join(seen, ["sku", "date"]).groupBy("sku", "fold").agg(
        F.avg(F.abs(F.col("v") - F.col("path"))).alias("mae"), F.sum("v").alias("realised"), F.max("scale").alias("scale"), F.max("ordered").alias("ordered"))
    gap = F.col("realised") - F.greatest(F.lit(0.0), F.col("ordered"))
    q = round(ratio, 4)
    return rows.select("sku", "fold", F.when(F.col("scale") > 1e-12, F.col("mae") / F.col("scale")).alias("mase"), F.greatest(F.lit(q) * gap, F.lit(q - 1) * gap).alias("pinball"))


def calendar_coverage(festivals: DataFrame, last_days: DataFrame, horizon: int) -> DataFrame:
    """What the calendar can say about each product's window: bounds, and a note where the window runs past them."""
    bounds = festivals.agg(F.min("day").alias("first_known"), F.max("day").alias("last_known"))
    rows = last_days.crossJoin(F.broadcast(bounds)).withColumn("window_end", F.date_add("last", horizon))  # one row
    note = F.when(F.col("window_end") > F.col("last_known"), F.format_string("the festival calendar ends on %s and cannot speak about %s", F.col("last_known").cast("string"), F.col("window_end").cast("string")))
    return rows.select("sku", "first_known", "last_known", note.alias("note"))


def plan_message(plan: DataFrame) -> DataFrame:
    """A sentence on each plan."""
    text = F.when(F.col("state") == "adjusted", F.format_string("The order is moved by a factor of %s: %d of the days ahead lie in a run-up.", F.format_number("factor", 2), F.col("days_adjusted"))).when(
        F.col("state") == "advisory", "There is a festival in these days or soon after, and no figure for what it does to this product; the order stays.").otherwise("No festival is near; the order stays.")
    return plan.withColumn("message", text)
