"""Registered queries of files, checks, records and reports, each beside its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import schema as S
from larder.functions.costs import bin_masses, grid_with, nearest
from larder.operators import demand, models, ordering, products, requests, results, service
from larder.operators import forecasting as fc
from larder.operators import hierarchy as tree
from larder.plans import oracles as O
from larder.plans import queries as Q
from larder.sources import files
from larder.sources.jobs import Jobs
from larder.sources.manifest import Published
from larder.sources.rules import default_rules
from larder.sources.shared import fresh

QUERIES, ORACLES = {}, {}
A = Q.AHEAD


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# Files ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {O.CALENDAR} SELECT date, CAST(wday AS TINYINT) AS wday, CAST(year AS SMALLINT) AS year, event FROM cal")
def calendar_csv(spark, sf_dir):
    """The calendar written as CSV and read as text, each column then cast; an empty field is null."""
    path = fresh(spark, "calendar")
    demand.calendar(Q._days(spark, sf_dir)).select("date", "wday", "year", "event").write.csv(path, header=True, emptyValue="")
    return files.read_text_columns(spark, path, {"date": "date", "wday": "tinyint", "year": "smallint", "event": "string"})


_LAST = "(SELECT max(date) FROM fact)"


@query(f"""WITH {O.FACT} SELECT store_id, item_id, strftime(date, '%Y-%m-%d') AS d, CAST(units AS BIGINT) AS units, p.price AS week_price FROM fact
  JOIN (SELECT item_id, store_id, max(price) AS price FROM fact WHERE date > {_LAST} - 7 GROUP BY 1, 2) p USING (item_id, store_id) WHERE store_id IN ('ASIA', 'EUROPE') AND date > {_LAST} - 14""")
def sales_csv(spark, sf_dir):
    """A wide sales file of two stores read back, unpivoted, and joined with prices that two semi-joins cut to what is sold."""
    root, panel = fresh(spark, "sales"), Q.fact(spark, sf_dir)
    last = panel.agg(F.max("date").alias("last"))
    recent = panel.crossJoin(F.broadcast(last)).where(F.col("date") > F.date_sub("last", 14))  # one row
    days = [str(r.date) for r in recent.select("date").distinct().orderBy("date").collect()]  # 14 at most
    demand.wide_sales(recent, days).write.csv(f"{root}/sales.csv", header=True)
    price = recent.where(F.col("date") > F.date_sub("last", 7)).groupBy("store_id", "item_id").agg(F.max("price").alias("sell_price"))
    price.select("store_id", "item_id", F.lit(0).alias("wm_yr_wk"), "sell_price").write.csv(f"{root}/prices.csv", header=True)
    files.require_files(spark, root, ["sales.csv", "prices.csv"])
    wide = files.read_sales_wide(spark, f"{root}/sales.csv", store_id=("ASIA", "EUROPE"))
    long = demand.unpivot_sales(wide, ["item_id", "dept_id", "store_id"]).withColumn("units", F.col("units").cast("long"))
    return long.join(files.read_prices(spark, f"{root}/prices.csv", wide), ["item_id", "store_id"]).select("store_id", "item_id", "d", "units", F.col("sell_price").alias("week_price"))


@query(f"WITH {O.UPLOAD} SELECT sku, date, round(units_sold, 6) AS units_sold FROM merged UNION ALL SELECT 'unreadable lines', NULL, 2.0::DOUBLE")
def upload_csv(spark, sf_dir):
    """An upload of several files with two broken lines: the rows that could be read, by day, and the number of others."""
    path = fresh(spark, "upload")
    Q._upload(spark, sf_dir).select("Product", "Day", "Qty", "Price").write.csv(path, header=True, emptyValue="")  # each file with its header
    broken = F.concat(F.lit("broken,line,"), F.col("id").cast("string"), F.lit(",1,2,3"))
    spark.range(0, 3, 1, 1).select(F.when(F.col("id") == 0, "Product,Day,Qty,Price").otherwise(broken).alias("value")).write.mode("append").text(path)  # three lines
    rows, bad = files.read_upload(spark, path)
    days = service.merge_days(service.usable(service.parse_upload(rows)))
    return Q.rounded(days.unionByName(bad.agg(F.lit("unreadable lines").alias("sku"), F.lit(None).cast("date").alias("date"), F.count("*").cast("double").alias("units_sold"))))


@query(f"WITH {O.TSB}, two AS (SELECT model_name, fold, yhat FROM naive UNION ALL SELECT model_name, fold, CASE WHEN fold = 4 THEN 2 * yhat ELSE yhat END FROM tsb) SELECT model_name, fold, count(*) AS n, round(sum(yhat), 4) AS total FROM two GROUP BY 1, 2")
def scoped_rewrite(spark, sf_dir):
    """A forecast table whose one scope is written again, twice: the others stay, and the second time changes nothing."""
    panel, cut, naive = Q._naive(spark, sf_dir)
    path = fresh(spark, "forecast")
    files.replace_scope(naive.unionByName(fc.tsb(panel, cut)), path, ["model_name", "fold"])
    table = spark.read.parquet(path)
    again = table.where("model_name = 'tsb' and fold = 4").withColumn("yhat", F.col("yhat") * 2)
    store = fresh(spark, "again")
    files.append(again, store)
    for _ in range(2):
        files.replace_scope(spark.read.schema(again.schema).parquet(store), path, ["model_name", "fold"])
    return spark.read.parquet(path).groupBy("model_name", "fold").agg(F.count("*").alias("n"), F.round(F.sum("yhat"), 4).alias("total"))


@query(f"WITH {O.STRATA} SELECT item_id, stratum_name, 2 AS version, CASE WHEN stratum = 1 THEN NULL ELSE round(zero_share, 6) END AS zero_share FROM named")
def published_strata(spark, sf_dir):
    """Two versions of a table published one after the other: readers get the newer; NaN was written as null."""
    root = fresh(spark, "published")
    bands = Q.strata(spark, sf_dir).select("item_id", "stratum_name", "stratum", "zero_share")
    for version in (1, 2):
        one = bands.select("item_id", "stratum_name", F.lit(version).alias("version"), F.when(F.col("stratum") == 1, F.lit(float("nan"))).otherwise(F.round("zero_share", 6)).alias("zero_share"))
        step = fresh(spark, "step")
        files.append(one, step)
        files.publish(spark.read.schema(one.schema).parquet(step), root)
    return files.read_current(spark, root)


@query(f"WITH {O.MINT} SELECT level, nullif(split_part(node, '/', 1), '') AS state_id, nullif(split_part(node, '/', 2), '') AS store_id, nullif(split_part(node, '/', 3), '') AS dept_id, nullif(split_part(node, '/', 4), '') AS item_id, count(*) AS n_rows, round(sum(clipped), 4) AS yhat FROM reconciled GROUP BY ALL")
def forecast_store(spark, sf_dir):
    """Reconciled forecasts appended with the path as columns of their own and values of at least 0."""
    path = fresh(spark, "store")
    files.append(tree.stored(tree.reconcile(Q._base(spark, sf_dir)[2])), path)
    rows = spark.read.parquet(path)
    return rows.groupBy("level", *tree.PATH).agg(F.count("*").alias("n_rows"), F.round(F.sum("yhat"), 4).alias("yhat"))


@query("SELECT p_partkey, sha256(p_name || '|' || p_brand) AS content_id FROM part")
def content_ids(spark, sf_dir):
    return Q.table(spark, sf_dir, "part").select("p_partkey", files.content_id(F.concat_ws("|", "p_name", "p_brand")).alias("content_id"))


@query("SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS n_pages, count(*) FILTER (regexp_matches(url, '/[0-9]+(\\?|$)')) AS n_with_id FROM pages WHERE regexp_matches(url, '^[a-zA-Z]+://[^/:?#]+') GROUP BY 1")
def page_hosts(spark, sf_dir):
    """Pages by host, and how many of their addresses end in a numeric id."""
    rows = Q.table(spark, sf_dir, "pages").select(results.host(F.col("url")).alias("host"), F.col("url").rlike(r"/[0-9]+(\?|$)").alias("with_id")).where("host is not null")
    return rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_if("with_id").alias("n_with_id"))


@query("SELECT event_id, CAST(props->>'k' AS VARCHAR) AS k, CAST(props->>'k' IS NOT NULL AS INT) AS n_kept FROM events")
def event_properties(spark, sf_dir):
    kept = results.allowed_properties(F.col("props"))
    return Q.table(spark, sf_dir, "events").select("event_id", F.try_element_at(kept, F.lit("k")).alias("k"), F.coalesce(F.size(kept), F.lit(0)).alias("n_kept"))


# Checks -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {O.FOLDS} SELECT fold, origin_date, CASE WHEN origin_date >= test_start THEN 'tests days that it trains on' WHEN origin_date <= (SELECT min(date) FROM fact) THEN 'has no training data before its origin' WHEN test_end > (SELECT max(date) FROM fact) THEN 'ends after the panel' END AS fault FROM folds")
def fold_faults(spark, sf_dir):
    panel = Q.fact(spark, sf_dir)
    return fc.fold_faults(fc.folds(panel), panel)


@query(f"""WITH {O.TREE.split('base AS')[0].rstrip().rstrip(',')}, kids AS (SELECT regexp_replace(node, '/[^/]*$', '') AS node, date, sum(units) AS x, max(level) AS child_level FROM acts WHERE contains(node, '/') GROUP BY 1, 2)
  SELECT level AS parent_level, child_level, count(*) AS n_checked, count(*) FILTER (abs(units - x) > 1e-6) AS n_gaps FROM acts JOIN kids USING (node, date) GROUP BY 1, 2""")
def tree_check(spark, sf_dir):
    """Whether every parent is the sum of its children on each day, for all three pairs of levels."""
    return tree.gaps(tree.roll_up(Q.fact(spark, sf_dir), ["units"]), "units")


_GRID = sorted({*S.LEVELS, round(Q.COSTS.critical_ratio(), 4)})


@query(f"""WITH {O.UPLOAD}, g AS (SELECT * FROM (VALUES {", ".join(f"({i}::INT, {q}::DOUBLE)" for i, q in enumerate(_GRID))}) AS t(place, level)), near AS (SELECT place FROM g ORDER BY abs(level - {round(Q.COSTS.critical_ratio(), 4)!r}::DOUBLE), place LIMIT 1),
  w AS (SELECT sku, CASE WHEN count(*) OVER f = {A} THEN sum(units_sold) OVER f END AS total FROM brands WHERE units_sold IS NOT NULL WINDOW f AS (PARTITION BY sku ORDER BY date ROWS BETWEEN CURRENT ROW AND {A - 1} FOLLOWING)),
  t AS (SELECT sku, quantile_cont(total, [{", ".join(f"{q}::DOUBLE" for q in _GRID)}]) AS q FROM w GROUP BY 1)
  SELECT sku, place, level, place = (SELECT place FROM near) AS is_ratio, round(greatest(q[place + 1], 0), 6) AS value FROM t, g WHERE q IS NOT NULL""")
def quantile_grid(spark, sf_dir):
    """Each product's total at every level that a model is fitted at, the critical ratio among them, and which of them is nearest to it."""
    levels, ratio = grid_with(S.LEVELS, Q.COSTS.critical_ratio()), round(Q.COSTS.critical_ratio(), 4)
    brands = Q._brands(spark, sf_dir)
    long = brands.where("units_sold is not null").groupBy("sku").agg(F.count("*").alias("n")).where(F.col("n") >= A).select("sku")
    rows = service.baseline_totals(brands, A, levels).join(long, "sku", "left_semi").select("sku", F.posexplode("quantiles").alias("place", "value"))
    level = F.element_at(F.array(*[F.lit(q) for q in levels]), F.col("place") + 1)
    return Q.rounded(rows.select("sku", "place", level.alias("level"), (F.col("place") == nearest(levels, ratio)).alias("is_ratio"), "value"), exact=("level",))


@query(f"WITH {O.DAILY} SELECT date, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(day(date) AS INT) AS day_of_month, CAST(month(date) AS INT) AS month, CAST(isodow(date) >= 6 AS INT) AS is_weekend FROM (SELECT DISTINCT date FROM daily)")
def day_features(spark, sf_dir):
    return Q.daily(spark, sf_dir).select("date").distinct().withColumns(results.day_features(F.col("date")))


# Service ----------------------------------------------------------------------------------------------------------------

_ORIGINS = f"""origins AS (SELECT sku, date, units_sold, {O._origin()}, row_number() OVER (PARTITION BY sku ORDER BY date DESC) - 1 AS back, count(*) OVER (PARTITION BY sku) AS n FROM brands WINDOW w AS (PARTITION BY sku ORDER BY date)),
ahead AS (SELECT * EXCLUDE (back, n, date, units_sold, h), date AS origin_date, CAST(h AS INT) AS horizon, CAST(date + h AS DATE) AS target_date FROM origins, (SELECT CAST(unnest(range(1, {A + 1})) AS INT) AS h) WHERE back % greatest(CAST(ceil(n * {A} / 8000.0) AS BIGINT), 1) = 0)"""


@query(f"""WITH {O.UPLOAD}, {_ORIGINS} SELECT a.*, b.units_sold AS y, CAST(isodow(target_date) - 1 AS INT) AS day_of_week, CAST(day(target_date) AS INT) AS day_of_month, CAST(month(target_date) AS INT) AS month, CAST(isodow(target_date) >= 6 AS INT) AS is_weekend
  FROM ahead a JOIN brands b ON b.sku = a.sku AND b.date = a.target_date WHERE b.units_sold IS NOT NULL""")
def supervised_daily(spark, sf_dir):
    return Q.rounded(results.supervised(Q._brands(spark, sf_dir), A))


@query(f"""WITH {O.UPLOAD}, seen AS (SELECT sku, date, units_sold AS v, units_sold - lag(units_sold, 7) OVER (PARTITION BY sku ORDER BY date) AS residual, row_number() OVER (PARTITION BY sku ORDER BY date DESC) AS back FROM brands WHERE units_sold IS NOT NULL),
  one AS (SELECT sku, quantile_cont(residual, {O._LEVELS}) AS o, list(v ORDER BY date) FILTER (back <= 7) AS week FROM seen GROUP BY 1),
  grid AS (SELECT sku, week, unnest({O._LEVELS}) AS quantile, unnest(o) AS offset_ FROM one WHERE len(week) = 7 AND o IS NOT NULL)
  SELECT sku, h AS horizon, quantile, round(greatest(0.0::DOUBLE, week[(h - 1) % 7 + 1] + offset_), 6) AS value FROM grid, (SELECT CAST(unnest(range(1, {A + 1})) AS INT) AS h)""")
def baseline_daily(spark, sf_dir):
    return Q.rounded(results.baseline_daily(Q._brands(spark, sf_dir), A, S.LEVELS), exact=("quantile",))


def _resolved(spark, sf_dir, history=None):
    """Brands by their own sales, and the named products by rule."""
    _, feasts = Q._festivals(spark, sf_dir)
    history = Q._brands(spark, sf_dir) if history is None else history
    skus = Q._skus(spark, sf_dir).distinct()
    keys = feasts.select("key", "prior_only").distinct()
    pairs = skus.crossJoin(F.broadcast(keys))  # eight festivals
    return feasts, results.resolve_uplift(pairs, service.uplift(service.occurrences(history, feasts)), service.keyword_matches(skus, default_rules(spark)))


_RESOLVED = O.OCCURRENCES.format(series="brands") + ", " + O.MATCHES + """,
pairs AS (SELECT * FROM (SELECT DISTINCT sku FROM skus), (SELECT DISTINCT key, prior_only FROM feasts)),
resolved AS (SELECT p.sku, p.key, coalesce(e.multiplier, a.multiplier) AS multiplier, CASE WHEN e.sku IS NOT NULL THEN 'measured' WHEN a.sku IS NOT NULL THEN 'prior' ELSE 'unavailable' END AS source, CASE WHEN e.sku IS NULL THEN a.keyword END AS keyword,
  CASE WHEN e.sku IS NOT NULL THEN 'Its own sales ran at ' || printf('%.2f', e.multiplier) || ' of their usual level before ' || p.key || ', over ' || e.years || ' year(s).'
    WHEN a.sku IS NOT NULL THEN 'The rule for ' || a.category || ' (keyword ' || a.keyword || ') says ' || printf('%.2f', a.multiplier) || '; its own sales do not tell.' ELSE 'Nothing is known of ' || p.key || ' for this product.' END AS sentence
  FROM pairs p LEFT JOIN effects e ON e.sku = p.sku AND e.key = p.key AND NOT p.prior_only LEFT JOIN agreed a ON a.sku = p.sku AND a.festival_key = p.key)"""


@query(f"WITH {_RESOLVED} SELECT * REPLACE (round(multiplier, 6) AS multiplier) FROM resolved")
def resolve_uplift(spark, sf_dir):
    return Q.rounded(_resolved(spark, sf_dir)[1])


@query(f"""WITH {_RESOLVED}, lasts AS (SELECT DISTINCT sku, DATE '2000-08-05' AS last FROM skus), ahead AS (SELECT sku, last, last + h AS date FROM lasts, (SELECT CAST(unnest(range(1, {A + 1})) AS INT) AS h)),
  owned AS (SELECT a.sku, a.date, multiplier FROM ahead a JOIN resolved e USING (sku) JOIN feasts f ON f.key = e.key AND a.date >= window_start AND a.date < day WHERE multiplier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.sku, a.date ORDER BY abs(a.date - day), prior_only, f.key) = 1),
  summed AS (SELECT sku, last, avg(coalesce(multiplier, 1)) AS factor, count(multiplier) AS days_adjusted FROM ahead LEFT JOIN owned USING (sku, date) GROUP BY 1, 2)
  SELECT sku, round(factor, 6) AS factor, days_adjusted, CASE WHEN days_adjusted > 0 THEN 'adjusted' WHEN EXISTS (SELECT 1 FROM feasts WHERE window_start <= last + {A + 14} AND window_end > last) THEN 'advisory' ELSE 'none' END AS state, abs(factor - 1) >= 0.01 AS material FROM summed""")
def festival_plan_by_rule(spark, sf_dir):
    """Plans from 5 August 2000 on, when two civic days and a festival lie ahead: measured effects, and rules where there are none."""
    feasts, known = _resolved(spark, sf_dir)
    last = Q._skus(spark, sf_dir).distinct().withColumn("last", F.lit("2000-08-05").cast("date"))
    return Q.rounded(service.plan(last, feasts, known.where("multiplier is not null").select("sku", "key", "multiplier"), A))


@query(f"""WITH {O.DAILY}, y AS (SELECT DISTINCT year(date) AS y FROM daily), d AS (SELECT 'christmas' AS key, 'Christmas' AS name, make_date(y, 12, 25) AS day, 10 AS a, 1 AS b FROM y
  UNION ALL SELECT 'thanksgiving', 'Thanksgiving', make_date(y, 11, 1) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 21 AS INT), 7, 1 FROM y UNION ALL SELECT 'super_bowl', 'Super Bowl', make_date(y, 2, 1) + CAST(7 - isodow(make_date(y, 2, 1)) AS INT), 3, 0 FROM y)
  SELECT key, name, day, day - a AS window_start, day + b AS window_end, false AS prior_only FROM d""")
def festivals_us(spark, sf_dir):
    """Festivals of the other region in the years of the data."""
    return service.us_festivals(Q._days(spark, sf_dir).select(F.year("date").alias("year")).distinct())


def _records(spark, sf_dir):
    return results.result_rows(Q.sku_backtest(spark, sf_dir), Q.service_orders(spark, sf_dir))


_RECORDS = f"""orders_ AS ({O.ORACLES['service_orders']}), tests_ AS ({O.ORACLES['sku_backtest']}),
  whole AS (SELECT sku, CAST(round(mase * 1000000) AS BIGINT) AS m, CAST(round(pinball * 1000000) AS BIGINT) AS p FROM tests_),
  one AS (SELECT sku, CAST(count(*) AS INT) AS n_folds, ((2 * sum(m) + count(m)) // (2 * count(m))) / 1e6 AS mase, ((2 * sum(p) + count(p)) // (2 * count(p))) / 1e6 AS pinball,
    ((2 * (max(m) - min(m)) + 2) // 4) / 1e6 AS mase_spread, ((2 * (max(p) - min(p)) + 2) // 4) / 1e6 AS pinball_spread FROM whole GROUP BY 1),
  records AS (SELECT o.sku, order_qty, expected_cost, coalesce(n_folds, 0) AS n_folds, CAST(mase AS DOUBLE) AS mase, CAST(pinball AS DOUBLE) AS pinball, CAST(mase_spread AS DOUBLE) AS mase_spread, CAST(pinball_spread AS DOUBLE) AS pinball_spread,
    CASE WHEN n_folds IS NULL THEN 'not measured' WHEN mase < 1 THEN 'better than yesterday''s value' ELSE 'no better than yesterday''s value' END AS method_label, CASE WHEN order_qty IS NULL THEN 'failed' ELSE 'done' END AS status FROM orders_ o LEFT JOIN one USING (sku))"""


@query(f"WITH {_RECORDS} SELECT * FROM records")
def result_rows(spark, sf_dir):
    return Q.rounded(_records(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT sku, order_qty, CAST(row_number() OVER (ORDER BY order_qty DESC, sku) AS INT) AS place FROM records")
def ranked_orders(spark, sf_dir):
    """Products by order, largest first."""
    rows = Q.rounded(_records(spark, sf_dir)).select("sku", "order_qty")
    return results.placed(rows, [F.desc("order_qty"), F.col("sku")], fresh(spark, "ranked"))


@query("WITH " + O.OCCURRENCES.format(series="brands") + " SELECT sku, key, round(multiplier, 6) AS multiplier, CAST(row_number() OVER (PARTITION BY sku ORDER BY round(abs(multiplier - 1), 6) DESC, key) AS INT) AS place FROM effects")
def ranked_uplifts(spark, sf_dir):
    """A product's festivals by how far they move it."""
    _, feasts = Q._festivals(spark, sf_dir)
    rows = service.uplift(service.occurrences(Q._brands(spark, sf_dir), feasts)).select("sku", "key", "multiplier")
    return Q.rounded(results.ranked(rows, ["sku"], F.desc(F.round(F.abs(F.col("multiplier") - 1), 6)), "key"))


@query(f"WITH {O.TOTALS}, last AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date DESC) AS back FROM dense), h AS (SELECT sku, string_agg(date || ':' || coalesce(printf('%.2f', round(units_sold, 2)), '-'), ',' ORDER BY date) AS history, count(*) AS n_days FROM last WHERE back <= 30 GROUP BY 1) SELECT sku, history, n_days, round(greatest(q[1], 0), 6) AS low, round(greatest(q[3], 0), 6) AS middle, round(greatest(q[5], 0), 6) AS high FROM h LEFT JOIN totals USING (sku)")
def chart_series(spark, sf_dir):
    series = Q._brands(spark, sf_dir)
    return Q.rounded(results.chart_series(series, service.baseline_totals(series, A, S.LEVELS), 30))


@query(f"""WITH r AS ({O.ORACLES['gate_report']}), v AS ({O.ORACLES['gate_verdicts']}), x AS (SELECT 'mixed' AS kind, 0 AS n, '' AS t UNION ALL SELECT 'ambiguous', 0, '' UNION ALL SELECT 'dates' AS kind, rows_without_date AS n, 'row(s) without a readable date were left out' AS t FROM r UNION ALL SELECT 'merged', rows_merged, 'row(s) of a day that another row has too were added up' FROM r
  UNION ALL SELECT 'negative', negative_units, 'negative amount(s) were read as 0' FROM r) SELECT kind, n, CASE WHEN n > 0 THEN n || ' ' || t END AS message, (SELECT fatal IS NULL FROM r) AND (SELECT count(*) FILTER (admitted) > 0 FROM v) AS usable FROM x""")
def gate_warnings(spark, sf_dir):
    return results.gate_warnings(Q._upload(spark, sf_dir))


@query(f"WITH {O.UPLOAD} SELECT sku, n_days FROM verdicts WHERE reasons <> '' ORDER BY n_days, sku LIMIT 5")
def worst_rejected(spark, sf_dir):
    return results.worst_rejected(service.gate(Q._upload(spark, sf_dir))).select("sku", "n_days")


@query(f"""WITH {O.UPLOAD}, gone AS (SELECT sku FROM verdicts WHERE reasons <> '') SELECT 'products' AS what, count(*) AS n FROM (SELECT DISTINCT sku FROM dense WHERE sku NOT IN (SELECT sku FROM gone)) UNION ALL SELECT 'days', count(*) FROM dense WHERE sku NOT IN (SELECT sku FROM gone)""")
def cascade_delete(spark, sf_dir):
    """What is left when refused products are deleted with all that hangs on them."""
    raw = Q._upload(spark, sf_dir)
    series = Q._brands(spark, sf_dir)
    kept, days = results.cascade(series.select("sku").distinct(), series, service.gate(raw).where("not admitted"), "sku")
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(kept, "products").unionByName(count(days, "days"))


@query(f"WITH {O.FOLDS} SELECT count(*) > 0 AS healthy, count(*) AS n_rows, max(origin_date) AS newest_origin FROM targets JOIN fact ON date = origin_date - 7 + (horizon - 1) % 7 + 1")
def health(spark, sf_dir):
    rows = Q.seasonal_naive(spark, sf_dir)
    return rows.agg((F.count("*") > 0).alias("healthy"), F.count("*").alias("n_rows"), F.max("origin_date").alias("newest_origin"))


# One product from model to order ------------------------------------------------------------------------------------------

_Q = round(Q.COSTS.critical_ratio(), 4)


_GUARD = " HAVING count(*) >= 60 AND count(*) FILTER (ends <= origin_date) >= 24"


def _learned(origins: str, levels: str, p: str, guard: str = _GUARD) -> str:
    """SQL of the leaves over the origins of a table: daily and total quantiles."""
    return f"""{p}past AS (SELECT r.*, fold, origin_date FROM learning r JOIN {origins} o ON o.sku = r.sku AND date <= origin_date),
  {p}one AS (SELECT sku, fold, origin_date, quantile_cont(v, {levels}) AS whole, max_by(rising, date) AS before, avg(change) AS scale FROM {p}past GROUP BY 1, 2, 3{guard}),
  {p}leaves AS (SELECT sku, fold, weekday, before, quantile_cont(v, {levels}) AS leaf FROM {p}past GROUP BY 1, 2, 3, 4),
  {p}ahead AS (SELECT *, CAST(origin_date + h AS DATE) AS date, isodow(origin_date + h) AS weekday FROM {p}one, (SELECT CAST(unnest(range(1, {A + 1})) AS INT) AS h)),
  {p}daily AS (SELECT sku, fold, a.origin_date, a.date, a.scale, coalesce(leaf, whole) AS q FROM {p}ahead a LEFT JOIN {p}leaves USING (sku, fold, weekday, before)),
  {p}leaf_totals AS (SELECT sku, fold, rising AS before, quantile_cont(total, {levels}) AS leaf FROM {p}past WHERE ends <= origin_date GROUP BY 1, 2, 3),
  {p}whole_totals AS (SELECT sku, fold, quantile_cont(total, {levels}) AS t FROM {p}past WHERE ends <= origin_date GROUP BY 1, 2),
  {p}totals AS (SELECT sku, fold, coalesce(leaf, t) AS q FROM {p}one LEFT JOIN {p}leaf_totals USING (sku, fold, before) LEFT JOIN {p}whole_totals USING (sku, fold))"""


_LEARNING = f"""recorded AS (SELECT sku, date, CAST(units_sold AS DOUBLE) AS v FROM brands WHERE units_sold IS NOT NULL),
  marked AS (SELECT *, isodow(date) AS weekday, round(avg(v) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) > round(avg(v) OVER (w ROWS BETWEEN 90 PRECEDING AND CURRENT ROW), 6) AS rising,
    CASE WHEN count(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND {A} FOLLOWING) = {A} THEN sum(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND {A} FOLLOWING) END AS total, lead(date, {A}) OVER w AS ends,
    CASE WHEN date > min(CASE WHEN v > 0 THEN date END) OVER (PARTITION BY sku) THEN abs(v - lag(v) OVER w) END AS change FROM recorded WINDOW w AS (PARTITION BY sku ORDER BY date)),
  learning AS (SELECT *, coalesce(lag(rising, {A}) OVER (PARTITION BY sku ORDER BY date), false) AS before FROM marked)"""

_TESTED = f"""{_LEARNING}, lengths AS (SELECT sku, count(*) AS n_days, max(date) AS last FROM brands GROUP BY 1), numbers AS (SELECT *, CAST(greatest(0, least(5, floor((n_days - 28) / {A}))) AS INT) AS n FROM lengths),
  cuts AS (SELECT sku, fold, last - (n - fold) * {A} AS origin_date FROM (SELECT *, CAST(unnest(range(n)) AS INT) AS fold FROM numbers)), {_learned("cuts", f"[0.5::DOUBLE, {_Q}::DOUBLE]", "m_")},
  met AS (SELECT sku, fold, avg(abs(v - q[1])) AS mae, max(scale) AS scale, sum(v) AS realised FROM m_daily JOIN recorded USING (sku, date) GROUP BY 1, 2),
  tested AS (SELECT sku, fold, round(mae, 6) AS mae, round(CASE WHEN scale > 1e-12 THEN mae / scale END, 6) AS mase, round(greatest({_Q}::DOUBLE * (realised - q[2]), {_Q - 1!r}::DOUBLE * (realised - q[2])), 9) AS pinball FROM met LEFT JOIN m_totals USING (sku, fold))"""


@query(f"WITH {O.UPLOAD}, {_TESTED} SELECT sku, fold, mae, mase, pinball FROM tested")
def sku_model_backtest(spark, sf_dir):
    """The learned model on each product's own folds."""
    out = products.backtest(Q._brands(spark, sf_dir), A, Q.COSTS.critical_ratio())
    return out.withColumns({"mae": F.round("mae", 6), "mase": F.round("mase", 6), "pinball": F.round("pinball", 9)})  # a quantile times a ratio has eight places


def sku_boosted_backtest(spark, sf_dir):
    """Boosted trees at both grains on each product's own folds; tests hold them against brute force."""
    return Q.rounded(products.boosted_backtest(Q._brands(spark, sf_dir), A, Q.COSTS.critical_ratio()))


QUERIES["sku_boosted_backtest"] = sku_boosted_backtest


def _methods(spark, sf_dir):
    brands = Q._brands(spark, sf_dir)
    folds = brands.groupBy("sku").agg(service.fold_count(F.count("*"), A).alias("n_folds"))
    return products.chosen(folds, sku_model_backtest(spark, sf_dir), Q.sku_backtest(spark, sf_dir))


def _three(total: str, n: str) -> str:
    t = f"((2 * {total} + 1000 * {n}) // (2000 * {n}))"
    return f"({t} // 1000) || '.' || lpad(CAST({t} % 1000 AS VARCHAR), 3, '0')"


def _test_sums(table: str, x: str) -> str:
    whole = "CAST(floor({} * 1000000 + 0.5) AS BIGINT)"
    return f"(SELECT sku, sum({whole.format('pinball')}) AS {x}_p, count(pinball) AS {x}_n, sum({whole.format('mase')}) AS {x}_m, count(mase) AS {x}_k FROM {table} GROUP BY 1)"


_OVER = "' over ' || least(m_n, b_n) || ' fold(s)' || CASE WHEN least(m_n, b_n) < n_folds THEN ' of ' || n_folds || ', the others too early for a model' ELSE '' END || '.'"
_DAILY_ERROR = f"' Daily error, scaled: model ' || CASE WHEN m_k > 0 THEN {_three('m_m', 'm_k')} ELSE 'unknown' END || ', repeated week ' || CASE WHEN b_k > 0 THEN {_three('b_m', 'b_k')} ELSE 'unknown' END || '.'"
_METHODS = f"""{_TESTED}, base_tests AS ({O.ORACLES['sku_backtest']}),
  pair AS (SELECT sku, n AS n_folds, m.* EXCLUDE (sku), b.* EXCLUDE (sku), CASE WHEN m_n > 0 THEN m_p / (m_n * 1e6::DOUBLE) END AS model, CASE WHEN b_n > 0 THEN b_p / (b_n * 1e6::DOUBLE) END AS baseline
    FROM numbers LEFT JOIN {_test_sums('tested', 'm')} m USING (sku) LEFT JOIN {_test_sums('base_tests', 'b')} b USING (sku)),
  tried AS (SELECT *, abs(model - baseline) / greatest(abs(model), abs(baseline), 1e-9) < 0.05 AS close FROM pair),
  methods AS (SELECT sku, model, baseline, CASE WHEN model IS NULL OR close OR baseline < model THEN 'baseline' ELSE 'model' END AS method,
    CASE WHEN model IS NULL THEN 'No fold had enough history for a model, so the repeated week is used.'
      WHEN close THEN 'Too close to call, so the simpler repeated week is used: order loss ' || {_three('m_p', 'm_n')} || ' by the model and ' || {_three('b_p', 'b_n')} || ' by the repeated week' || {_OVER} || {_DAILY_ERROR}
      WHEN baseline < model THEN 'The repeated week orders better: loss ' || {_three('b_p', 'b_n')} || ' against ' || {_three('m_p', 'm_n')} || ' by the model' || {_OVER} || {_DAILY_ERROR}
      ELSE 'The model orders better: loss ' || {_three('m_p', 'm_n')} || ' against ' || {_three('b_p', 'b_n')} || ' by the repeated week' || {_OVER} || {_DAILY_ERROR}
        || CASE WHEN m_k > 0 AND b_k > 0 AND b_m * m_k < m_m * b_k THEN ' Day by day the repeated week was closer; the loss of the order decides.' ELSE '' END END
    || coalesce(' ' || CASE WHEN model IS NULL THEN {O.CAVEAT.format('coalesce(b_n, 0)')} ELSE {O.CAVEAT.format('least(m_n, b_n)')} END, '') AS reason FROM tried)"""


@query(f"WITH {O.UPLOAD}, {_METHODS} SELECT sku, round(model, 4) AS model, round(baseline, 4) AS baseline, method, reason FROM methods")
def sku_methods(spark, sf_dir):
    """Model or baseline for each product, by its own backtests."""
    return Q.rounded(_methods(spark, sf_dir), 4)


@query(f"""WITH {O.UPLOAD}, {_LEARNING}, ends_ AS (SELECT sku, 0 AS fold, max(date) AS origin_date FROM recorded GROUP BY 1), {_learned("ends_", O._LEVELS, "f_", "")}
  SELECT sku, date, list_transform(q, lambda x: round(x, 6)) AS quantiles FROM f_daily""")
def sku_daily_quantiles(spark, sf_dir):
    """Quantiles of each day ahead of each product's last recorded day, of every product that has one."""
    rows = products.learning_rows(Q._brands(spark, sf_dir), A)
    daily = products.learned(rows, rows.groupBy("sku").agg(F.lit(0).alias("fold"), F.max("date").alias("origin_date")), A, S.LEVELS, guarded=False)[0]
    return daily.select("sku", "date", F.transform("quantiles", lambda x: F.round(x, 6)).alias("quantiles"))


_ORDERS = O.ORACLES["service_orders"].removeprefix(f"WITH {O.TOTALS}, ").replace("FROM totals", "FROM picked").replace(" AS order_qty FROM o)", " AS order_before FROM o), moved AS (SELECT w.*, factor, state, order_before * factor AS order_qty FROM w JOIN planned USING (sku))").replace(
    "AS expected_cost FROM w", "AS expected_cost, round(order_before, 6) AS order_before, round(factor, 6) AS factor, state FROM moved")
_PLANNED = O.OCCURRENCES.format(series="brands").removeprefix(f"{O.UPLOAD}, ") + f""",
  plan_last AS (SELECT sku, max(date) AS last FROM brands GROUP BY 1), plan_days AS (SELECT sku, last, last + h AS date FROM plan_last, (SELECT CAST(unnest(range(1, {A + 1})) AS INT) AS h)),
  plan_owned AS (SELECT a.sku, a.date, multiplier FROM plan_days a JOIN effects e USING (sku) JOIN feasts f ON f.key = e.key AND a.date >= window_start AND a.date < day QUALIFY row_number() OVER (PARTITION BY a.sku, a.date ORDER BY abs(a.date - day), prior_only, f.key) = 1),
  planned AS (SELECT sku, avg(coalesce(multiplier, 1)) AS factor, CASE WHEN count(multiplier) > 0 THEN 'adjusted' WHEN EXISTS (SELECT 1 FROM feasts WHERE window_start <= last + {A + 14} AND window_end > last) THEN 'advisory' ELSE 'none' END AS state
    FROM plan_days LEFT JOIN plan_owned USING (sku, date) GROUP BY sku, last)"""


@query(f"""WITH {O.TOTALS}, {_PLANNED}, {_METHODS}, ends_ AS (SELECT sku, 0 AS fold, max(date) AS origin_date FROM recorded GROUP BY 1), {_learned("ends_", O._LEVELS, "f_")},
  served AS (SELECT sku, reason, CASE WHEN method = 'model' AND f_totals.q IS NOT NULL THEN 'model' ELSE 'baseline' END AS method, f_totals.q AS fq FROM methods LEFT JOIN f_totals USING (sku)),
  picked AS (SELECT sku, CASE WHEN method = 'model' THEN fq ELSE q END AS q FROM totals JOIN served USING (sku)), ordered AS (WITH {_ORDERS})
  SELECT sku, method, reason, price, order_before, factor, state, order_qty, expected_cost FROM ordered JOIN served USING (sku)""")
def forecast_sku(spark, sf_dir):
    """Each product from its uploaded history to an order: model and baseline tested on its folds, the better one fitted on all of it, and
    the order moved by what festivals ahead did to its sales before."""
    brands, prices = Q._brands(spark, sf_dir), Q.resolve_price(spark, sf_dir)
    _, feasts = Q._festivals(spark, sf_dir)
    effects = service.uplift(service.occurrences(brands, feasts)).select("sku", "key", "multiplier")
    plans = service.plan(brands.groupBy("sku").agg(F.max("date").alias("last")), feasts, effects, A)
    out = products.forecast(brands, _methods(spark, sf_dir), prices, Q.COSTS, A, S.LEVELS, plans)
    return Q.rounded(out.withColumn("expected_cost", F.round("expected_cost", 2)))


@query(f"""WITH {O.UPLOAD}, n AS (SELECT sku, count(units_sold) AS n FROM dense GROUP BY 1)
  SELECT 'tonight' AS job, sku, CASE WHEN n < 60 THEN 'failed' ELSE 'done' END AS status, CASE WHEN sku LIKE 'Brand#1%' THEN 4 ELSE 2 END::INT AS version, CASE WHEN n < 60 THEN 'ValueError: 60 recorded days needed, ' || n || ' found' END AS note FROM n""")
def job_states(spark, sf_dir):
    """A job over all products that is cut off once: an attempt takes some products and never ends, and the next one takes them up again."""
    days = service.daily(service.usable(service.parse_upload(Q._upload(spark, sf_dir))))
    jobs = Jobs(spark, fresh(spark, "jobs"))
    jobs.submit("tonight", days.select("sku").where("sku like 'Brand#1%'"))
    jobs.advance("tonight", "running", "first")
    jobs.submit("tonight", days.select("sku"))
    jobs.resume("tonight", ["first"])
    jobs.run("tonight", days, Q.sku_fit, ["total", "sigma"], "sku string, status string, error string, total double, sigma double")
    return jobs.latest().select("job", "sku", "status", "version", "note")


@query(f"""WITH m AS ({O.ORACLES['money_table']}), o AS ({O.ORACLES['order_policy']}), w AS (SELECT * FROM m WHERE policy = 'newsvendor')
  SELECT count(*) AS n_orders, round(sum(order_qty), 4) AS ordered, (SELECT n_rows FROM w) AS n_scored, (SELECT total_cost FROM w) AS total_cost, 1 AS refresh FROM o""")
def published_set(spark, sf_dir):
    """Orders and their score published together, and read while the next refresh has written its orders and not its score."""
    out = Published(spark, fresh(spark, "published-set"))
    done = out.commit(out.stage(policy=Q.order_policy(spark, sf_dir).withColumn("refresh", F.lit(1)), money=Q.money_table(spark, sf_dir)), 0)
    tables = out.read()
    out.stage(policy=tables["policy"].withColumn("order_qty", F.col("order_qty") * 2).withColumn("refresh", F.lit(2)))  # no reader sees it
    now = out.read()
    score = now["money"].where("policy = 'newsvendor'").select(F.col("n_rows").alias("n_scored"), "total_cost")
    sums = now["policy"].groupBy("refresh").agg(F.count("*").alias("n_orders"), F.round(F.sum("order_qty"), 4).alias("ordered"))
    assert done == 1
    return sums.crossJoin(F.broadcast(score)).select("n_orders", "ordered", "n_scored", "total_cost", "refresh")  # one row each


_MIXED = f"""{O.UPLOAD}, styled AS (SELECT sku, CASE WHEN sku LIKE 'Brand%' THEN strftime(date, '%m/%d/%Y') ELSE strftime(date, '%d-%m-%Y') END AS d FROM upload),
  parts AS (SELECT *, TRY_CAST(regexp_extract(d, '^([0-9]+)[/-]([0-9]+)[/-]', 1) AS INT) AS a, TRY_CAST(regexp_extract(d, '^([0-9]+)[/-]([0-9]+)[/-]', 2) AS INT) AS b FROM styled),
  votes AS (SELECT count(*) FILTER (a > 12) AS n_day_first, count(*) FILTER (b > 12) AS n_month_first, count(*) FILTER (a <= 12 AND b <= 12 AND a <> b) AS n_either, count(*) FILTER (d IS NOT NULL AND a IS NULL) AS n_other FROM parts)"""


def _styled(spark, sf_dir):
    """An upload whose brands write the month first and whose events write the day first."""
    day = F.to_date("Day")
    return Q._upload(spark, sf_dir).withColumn("Day", F.when(F.col("Product").startswith("Brand"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd-MM-yyyy")))


@query(f"WITH {_MIXED} SELECT *, n_month_first > n_day_first AS month_first, n_day_first > 0 AND n_month_first > 0 AS mixed, n_day_first + n_month_first = 0 AND n_either > 0 AS ambiguous FROM votes")
def date_votes(spark, sf_dir):
    return service.date_votes(_styled(spark, sf_dir))


@query(f"""WITH {_MIXED}, read AS (SELECT sku, CASE WHEN (SELECT n_month_first > n_day_first FROM votes) THEN coalesce(try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%m-%d-%Y'), try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%d-%m-%Y'))
    ELSE coalesce(try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%d-%m-%Y'), try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%m-%d-%Y')) END AS t FROM styled)
  SELECT sku, count(*) AS n_rows, count(t) AS n_read, CAST(min(t) AS DATE) AS first_date, CAST(max(t) AS DATE) AS last_date FROM read GROUP BY 1""")
def dates_by_vote(spark, sf_dir):
    """What each product's days become when the whole file votes on the order of day and month."""
    raw = _styled(spark, sf_dir)
    rows = service.parse_upload(raw, service.date_votes(raw))
    return rows.groupBy("sku").agg(F.count("*").alias("n_rows"), F.count("date").alias("n_read"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# Reports ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {O.DAILY}, s AS (SELECT item_id, store_id, min(date) AS first_day, max(date) AS last_day, CAST(sum(units) AS BIGINT) AS units FROM daily GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY units DESC, item_id, store_id LIMIT 6) SELECT * FROM s""")
def demo_series(spark, sf_dir):
    """The six series that sold most, of those with two days or more."""
    one = Q.daily(spark, sf_dir).groupBy("item_id", "store_id").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.sum("units").alias("units"), F.count("*").alias("n"))
    return one.where("n >= 2").drop("n").orderBy(F.desc("units"), "item_id", "store_id").limit(6)


@query(f"WITH x AS ({O.ORACLES['level_comparison']}) SELECT *, CASE level WHEN 'state' THEN 1 WHEN 'store' THEN 2 WHEN 'dept' THEN 3 ELSE 4 END::INT AS place FROM x ORDER BY place")
def level_report(spark, sf_dir):
    """Levels from the top down."""
    place = F.array_position(F.array(*[F.lit(x) for x in tree.LEVELS]), F.col("level")).cast("int")
    return Q.level_comparison(spark, sf_dir).withColumn("place", place).orderBy("place")


@query(f"""WITH x AS ({O.ORACLES['pinball_scores']}), s AS (SELECT model_name, metric, sum(CAST(round(value * 1000000) AS BIGINT)) AS total, count(*) AS n_folds FROM x WHERE metric LIKE 'pinball_q%' AND ends_with(metric, '5') GROUP BY 1, 2)
  SELECT model_name, metric, CAST(((2 * total + 10 * n_folds) // (20 * n_folds)) / 1e5 AS DOUBLE) AS value, n_folds FROM s""")
def pinball_report(spark, sf_dir):
    """Mean loss over folds, five places, of the metrics whose name begins with the loss's and ends with a 5."""
    rows = Q.pinball_scores(spark, sf_dir).where(F.col("metric").startswith("pinball_q") & F.col("metric").endswith("5"))
    total = F.sum(F.round(F.col("value") * 1_000_000).cast("long"))
    one = rows.groupBy("model_name", "metric").agg(total.alias("total"), F.count("*").alias("n_folds"))
    return one.select("model_name", "metric", (F.floor((2 * F.col("total") + 10 * F.col("n_folds")) / (20 * F.col("n_folds"))) / F.lit(1e5)).alias("value"), "n_folds")


_ASKED = f"""asked AS (SELECT p_partkey AS request_id, CASE WHEN p_partkey % 17 = 0 THEN 'Brand' ELSE p_brand END AS item_id, CAST(CASE WHEN p_partkey % 7 < 5 THEN p_partkey % 7 WHEN p_partkey % 7 = 5 THEN 4 ELSE 6 END AS INT) AS fold,
    CAST(CASE WHEN p_partkey % 11 = 0 THEN {S.HORIZON} ELSE p_size % 32 END AS INT) AS horizon, CAST(p_partkey % 23 AS DOUBLE) / 20 AS margin, CAST(p_partkey % 13 AS DOUBLE) / 10 AS spoilage, {Q.COSTS.holding}::DOUBLE AS holding FROM part),
  costed AS (SELECT *, margin > 0 AND margin < 1 AND spoilage <= 1 AS good, margin / nullif(margin + (1 - margin) * (spoilage + holding), 0) AS r FROM asked),
  judged AS (SELECT * EXCLUDE (good, r), CASE WHEN good THEN r END AS critical_ratio, nullif(concat_ws('; ', CASE WHEN item_id NOT IN (SELECT item_id FROM fact) THEN 'no such item' END, CASE WHEN fold NOT IN (SELECT fold FROM folds) THEN 'no such fold' END,
    CASE WHEN horizon NOT BETWEEN 1 AND {S.HORIZON} THEN 'the horizon must lie in 1 to {S.HORIZON}' END, CASE WHEN NOT (margin > 0 AND margin < 1) THEN 'the margin must lie between 0 and 1' END, CASE WHEN spoilage > 1 THEN 'spoilage must lie in 0 to 1' END,
    CASE WHEN good AND NOT r BETWEEN {S.LEVELS[0]} AND {S.LEVELS[-1]} THEN 'the critical ratio lies outside the quantiles' END), '') AS fault FROM costed)"""
_BENT = "CASE " + " ".join(f"WHEN critical_ratio <= {b} THEN q[{i}] + (critical_ratio - {a}::DOUBLE) / {b - a!r}::DOUBLE * (q[{i + 1}] - q[{i}])" for i, (a, b) in enumerate(zip(S.LEVELS[:-1], S.LEVELS[1:], strict=True), 1)) + " END"
_LOSS = " + ".join(f"{m!r}::DOUBLE * price * (greatest(q[{i}] - o, 0) * margin + greatest(o - q[{i}], 0) * (1 - margin) * (spoilage + holding))" for i, m in enumerate(bin_masses(S.LEVELS), 1))


@query(f"""WITH {O.PANEL}, {_ASKED}, met AS (SELECT j.*, store_id, p.demand, price, q, {_BENT} AS o FROM judged j JOIN panel p USING (item_id, fold) JOIN folds USING (fold) WHERE fault IS NULL AND target_date - origin_date <= j.horizon),
  summed AS (SELECT request_id, count(DISTINCT store_id) AS n_stores, sum(o) AS order_qty, sum(demand) AS demand, sum({_LOSS}) AS expected_cost FROM met GROUP BY 1)
  SELECT request_id, item_id, fold, horizon, margin, spoilage, holding, round(critical_ratio, 6) AS critical_ratio, fault, n_stores, round(order_qty, 4) AS order_qty, demand, round(expected_cost, 2) AS expected_cost FROM judged LEFT JOIN summed USING (request_id)""")
def asked_orders(spark, sf_dir):
    """A request for each part: its brand's order over some days of a fold at costs of its own; many ask for what there is not."""
    key = F.col("p_partkey")
    asked = Q.table(spark, sf_dir, "part").select(
        key.alias("request_id"), F.when(key % 17 == 0, "Brand").otherwise(F.col("p_brand")).alias("item_id"), F.when(key % 7 < 5, key % 7).when(key % 7 == 6, 6).cast("int").alias("fold"),
        F.when(key % 11 != 0, F.col("p_size") % 32).cast("int").alias("horizon"), ((key % 23) / 20).alias("margin"), ((key % 13) / 10).alias("spoilage"), F.lit(None).cast("double").alias("holding"))
    facts, panel = Q._panel(spark, sf_dir)
    known = requests.checked(asked, fc.folds(facts), facts, Q.COSTS)
    out = requests.answers(known, requests.sums_ahead(panel))
    return out.withColumns({"critical_ratio": F.round("critical_ratio", 6), "order_qty": F.round("order_qty", 4), "expected_cost": F.round("expected_cost", 2)})


@query(f"WITH x AS ({O.ORACLES['fold_metrics']}) SELECT * FROM x WHERE model_name = 'tsb' AND fold BETWEEN 2 AND 4 AND metric IN ('mase', 'rmsse')")
def backtest_answer(spark, sf_dir):
    """Scores of one model, of the later folds and of two metrics."""
    return requests.matching(Q.fold_metrics(spark, sf_dir), model_name="tsb", fold=(2, 4), metric=["mase", "rmsse"])


@query(f"WITH x AS ({O.ORACLES['mint_reconcile']}) SELECT * FROM x WHERE level = 'item' AND fold = 4 AND starts_with(node, 'ALL/ASIA/')")
def hierarchy_answer(spark, sf_dir):
    """Reconciled forecasts of one level below one store, of the latest fold."""
    return requests.matching(Q.mint_reconcile(spark, sf_dir), level="item", fold=4, node="ALL/ASIA/*")


@query(f"""WITH x AS ({O.ORACLES['coherence_gap']}) SELECT parent_level || ' > ' || child_level AS step, CAST(fold AS INT) AS fold, max(mean_abs_gap) FILTER (NOT reconciled) AS before, max(mean_abs_gap) FILTER (reconciled) AS after FROM x WHERE fold = (SELECT max(fold) FROM x) GROUP BY 1, 2""")
def coherence_report(spark, sf_dir):
    """Gaps between parents and children before and after reconciling, of the latest fold."""
    rows = Q.coherence_gap(spark, sf_dir)
    latest = rows.agg(F.max("fold").alias("latest"))
    rows = rows.join(F.broadcast(latest), F.col("fold") == F.col("latest"))  # one row
    gap = lambda done: F.max(F.when(F.col("reconciled") == done, F.col("mean_abs_gap")))
    return rows.groupBy(F.concat_ws(" > ", "parent_level", "child_level").alias("step"), "fold").agg(gap(False).alias("before"), gap(True).alias("after"))


@query(f"WITH {O.FOLDS}, n AS (SELECT fold, item_id, store_id, target_date, CAST(units AS DOUBLE) AS yhat FROM targets JOIN fact ON date = origin_date - 7 + (horizon - 1) % 7 + 1) SELECT item_id, store_id, target_date, yhat FROM n WHERE fold = (SELECT max(fold) FROM n) ORDER BY md5(item_id || '#' || store_id || '#' || target_date), item_id, store_id LIMIT 100")
def latest_sample(spark, sf_dir):
    """A hundred forecasts of the latest fold, chosen by a digest, so always the same."""
    rows = Q.seasonal_naive(spark, sf_dir)
    rows = rows.join(F.broadcast(rows.agg(F.max("fold").alias("latest"))), F.col("fold") == F.col("latest"))  # one row
    digest = F.md5(F.concat_ws("#", "item_id", "store_id", F.col("target_date").cast("string")))
    return rows.orderBy(digest, "item_id", "store_id").limit(100).select("item_id", "store_id", "target_date", "yhat")


@query(f"WITH {O.FOLDS}, n AS (SELECT fold, item_id, store_id, target_date, horizon, CAST(units AS DOUBLE) AS yhat FROM targets JOIN fact ON date = origin_date - 7 + (horizon - 1) % 7 + 1) SELECT item_id, target_date, horizon, sum(yhat) AS yhat, count(*) AS n_stores FROM n WHERE fold = (SELECT max(fold) FROM n) AND item_id = 'Brand#1' GROUP BY ALL")
def forecast_item(spark, sf_dir):
    """One item's forecast of the latest fold, summed over stores."""
    return ordering.forecast_item(Q.seasonal_naive(spark, sf_dir), "Brand#1")


@query(f"""WITH {O.FACT}, lately AS (SELECT DISTINCT item_id, store_id FROM daily WHERE date > {_LAST} - 28), nodes AS (SELECT DISTINCT 'ALL/' || store_id || '/' || dept_id || '/' || item_id AS node, item_id, store_id FROM fact), ahead_days AS (SELECT DISTINCT date AS target_date FROM fact WHERE date > {_LAST} - 28)
  SELECT node, target_date, CASE WHEN l.item_id IS NULL THEN 0.0::DOUBLE ELSE CAST(f.units AS DOUBLE) END AS yhat FROM nodes n CROSS JOIN ahead_days d LEFT JOIN lately l USING (item_id, store_id) LEFT JOIN fact f ON f.item_id = n.item_id AND f.store_id = n.store_id AND f.date = d.target_date""")
def filled_nodes(spark, sf_dir):
    """Forecasts of every series on every target day, 0 for series that have none."""
    panel = Q.fact(spark, sf_dir)
    recent = panel.crossJoin(F.broadcast(panel.agg(F.max("date").alias("last")))).where(F.col("date") > F.date_sub("last", 28))  # one row
    live = Q.daily(spark, sf_dir).join(F.broadcast(panel.agg(F.date_sub(F.max("date"), 28).alias("from"))), F.col("date") > F.col("from")).select("item_id", "store_id").distinct()
    rows = recent.join(live, ["item_id", "store_id"], "left_semi").select(F.concat_ws("/", *tree.PATH).alias("node"), F.col("date").alias("target_date"), F.col("units").cast("double").alias("yhat"))
    return tree.filled(rows, panel.select(F.concat_ws("/", *tree.PATH).alias("node")).distinct(), recent.select(F.col("date").alias("target_date")).distinct())


@query(f"""WITH x AS ({O.ORACLES['fold_metrics']}) SELECT model_name, fold, 'panel' AS data, max(value) FILTER (metric = 'mase') AS mase, max(value) FILTER (metric = 'rmsse') AS rmsse, max(n_series) AS n_series, 'horizon={S.HORIZON},season={S.SEASON}' AS params FROM x GROUP BY 1, 2""")
def runs(spark, sf_dir):
    """A record of each run: parameters as a map, written out as text, and its main figures."""
    rows = Q.fold_metrics(spark, sf_dir).groupBy("model_name", "fold").pivot("metric", ["mase", "rmsse"]).agg(F.max("value"))
    n = Q.fold_metrics(spark, sf_dir).groupBy("model_name", "fold").agg(F.max("n_series").alias("n_series"))
    params = F.create_map(F.lit("horizon"), F.lit(str(S.HORIZON)), F.lit("season"), F.lit(str(S.SEASON)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return rows.join(n, ["model_name", "fold"]).withColumns({"data": F.lit("panel"), "params": text})


# Smoothing ----------------------------------------------------------------------------------------------------------------


# A state is a list: level, season of the next seven days, squared error. It is folded over the days.
_STEP = "list_reduce({days}, lambda a, x: [a[1] + alpha * (x[1] - a[1] - a[2]), a[3], a[4], a[5], a[6], a[7], a[8], a[2] + gamma * (x[1] - a[1] - a[2]), a[9] + (x[1] - a[1] - a[2]) * (x[1] - a[1] - a[2])], {start})"
_START = "[mean, " + ", ".join(f"(y[{i}][1] + y[{i + 7}][1]) / 2 - mean" for i in range(1, 8)) + ", 0.0::DOUBLE]"
_GRID = ", ".join(f"({i}, {a}::DOUBLE, {g}::DOUBLE)" for i, (a, g) in enumerate(models.GRID))


def _ets(series: str, keys: str, quantiles: tuple[float, ...] = S.LEVELS) -> str:
    """Smoothing of the series of a table, from origin to origin."""
    folds = [f"s0 AS (SELECT {keys}, k, alpha, gamma, y, n - 140 AS t, " + _STEP.format(days="y[1:n - 140]", start="start") + " AS state FROM began)"]
    folds += [f"s{i} AS (SELECT * REPLACE (t + {S.HORIZON} AS t, {_STEP.format(days=f'y[t + 1:t + {S.HORIZON}]', start='state')} AS state) FROM s{i - 1})" for i in range(1, S.N_FOLDS)]
    best = " UNION ALL ".join(f"SELECT {i} AS fold, {keys}, t, arg_min(state, (state[9], k)) AS state, arg_min(alpha, (state[9], k)) AS alpha FROM s{i} GROUP BY ALL" for i in range(S.N_FOLDS))
    levels = ", ".join(f"({q}::DOUBLE, {z!r}::DOUBLE)" for q, z in models.Z.items() if q in quantiles)
    return f"""WITH ys AS (SELECT {keys}, list([CAST(units AS DOUBLE)] ORDER BY date) AS y, CAST(count(*) AS INT) AS n, max(date) AS last FROM {series} GROUP BY {keys}),
      firsts AS (SELECT *, list_avg(list_transform(y[1:14], lambda x: x[1])) AS mean FROM ys), grid(k, alpha, gamma) AS (VALUES {_GRID}),
      began AS (SELECT {keys}, y, n, last, k, alpha, gamma, {_START} AS start FROM firsts, grid),
      {", ".join(folds)}, best AS ({best}), z(quantile, z) AS (VALUES {levels}), ahead AS (SELECT CAST(unnest(range(1, {S.HORIZON + 1})) AS INT) AS horizon)
      SELECT 'ets' AS model_name, CAST(fold AS INT) AS fold, l.last - {S.HORIZON} * ({S.N_FOLDS} - fold) AS origin_date, l.last - {S.HORIZON} * ({S.N_FOLDS} - fold) + horizon AS target_date, horizon, {", ".join("b." + k for k in keys.split(", "))}, quantile,
        greatest(0.0::DOUBLE, state[1] + state[2 + (horizon - 1) % 7] + z * sqrt(state[9] / t) * sqrt(1 + (horizon - 1) * alpha * alpha)) AS yhat
      FROM best b JOIN ys l USING ({keys}), z, ahead"""


ORACLES["ets_forecast"] = f"WITH {O.FACT} SELECT * REPLACE (round(yhat, 6) AS yhat) FROM ({_ets('fact', 'item_id, store_id')})"

_WHOLE_BASE = f"""{O.NODES}, smoothed AS ({_ets("(SELECT * FROM acts WHERE level <> 'item')", "node, level", (0.5,))}), listed AS (SELECT item_id, store_id, min(date) AS listed FROM fact WHERE price IS NOT NULL GROUP BY 1, 2),
  spoken AS (SELECT node, fold, target_date, yhat FROM smoothed UNION ALL SELECT node, fold, target_date, yhat FROM tsb JOIN paths USING (item_id, store_id) JOIN listed USING (item_id, store_id) JOIN folds USING (fold) WHERE listed <= folds.origin_date),
  base AS (SELECT n.node, n.level, CAST(t.fold AS INT) AS fold, t.target_date, coalesce(yhat, 0.0::DOUBLE) AS yhat, yhat IS NULL AS filled FROM (SELECT DISTINCT node, level FROM acts) n CROSS JOIN targets t LEFT JOIN spoken s ON s.node = n.node AND s.fold = t.fold AND s.target_date = t.target_date)"""
ORACLES["base_forecasts"] = f"WITH {_WHOLE_BASE} SELECT * REPLACE (round(yhat, 6) AS yhat) FROM base"
ORACLES["reconciled_base"] = f"WITH {_WHOLE_BASE}{O.RECONCILED} SELECT * EXCLUDE (model_name) REPLACE (round(yhat, 6) AS yhat, round(reconciled, 6) AS reconciled, round(clipped, 6) AS clipped) FROM reconciled"

ORACLES["sku_jobs"] = f"""WITH {O.UPLOAD}, ys AS (SELECT sku, list([CAST(units_sold AS DOUBLE)] ORDER BY date) FILTER (units_sold IS NOT NULL) AS y, CAST(count(units_sold) AS INT) AS n FROM dense GROUP BY 1),
  began AS (SELECT *, list_avg(list_transform(y[1:14], lambda x: x[1])) AS mean FROM ys WHERE n >= 60), grid(k, alpha, gamma) AS (VALUES {_GRID}),
  ran AS (SELECT sku, n, k, {_STEP.format(days='y', start=_START)} AS state FROM began, grid), best AS (SELECT sku, n, arg_min(state, (state[9], k)) AS state FROM ran GROUP BY 1, 2)
  SELECT sku, CASE WHEN ys.n < 60 THEN 'failed' ELSE 'done' END AS status, CASE WHEN ys.n < 60 THEN 'ValueError: 60 recorded days needed, ' || ys.n || ' found' END AS error,
    CASE WHEN state IS NOT NULL THEN round(greatest(0.0::DOUBLE, {A} * state[1] + {A // 7} * list_sum(state[2:8])), 6) END AS total, round(sqrt(state[9] / ys.n), 6) AS sigma FROM ys LEFT JOIN best USING (sku)"""
