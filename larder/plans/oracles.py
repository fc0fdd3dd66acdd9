"""The registered queries as SQL for DuckDB, on the same tables."""

from __future__ import annotations

from larder import schema as S

H, NF, BT = S.HORIZON, S.N_FOLDS, S.BACKTEST_DAYS
_EVENT = "CASE strftime({0}, '%m-%d') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.EVENTS.items()) + " END"
_DEPT = "'DEPT_' || CAST(CAST(floor((CAST(regexp_extract(item_id, '([0-9]+)$', 1) AS INT) - 1) / 5) + 1 AS INT) AS VARCHAR)"

DAILY = """daily AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS item_id, r_name AS store_id, CAST(sum(l_quantity) AS INT) AS units, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""
FACT = DAILY + f""",
price AS (SELECT item_id, store_id, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(cents) AS DOUBLE) / (sum(units) * 100.0::DOUBLE) AS price FROM daily GROUP BY 1, 2, 3),
days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily),
series AS (SELECT DISTINCT item_id, store_id FROM daily),
fact AS (SELECT g.date, g.item_id, g.store_id, {_DEPT.replace('item_id', 'g.item_id')} AS dept_id, 'ALL' AS cat_id, 'ALL' AS state_id, coalesce(d.units, 0) AS units, p.price,
    CAST(day(g.date) <= 10 AS INT) AS snap, {_EVENT.format('g.date')} AS event
  FROM (SELECT * FROM series, days) g LEFT JOIN daily d USING (date, item_id, store_id) LEFT JOIN price p ON p.item_id = g.item_id AND p.store_id = g.store_id AND p.week = CAST(date_trunc('week', g.date) AS DATE))"""
CALENDAR = FACT + f""",
cal AS (SELECT date, CAST((dayofweek(date) + 1) % 7 + 1 AS INT) AS wday, dayname(date) AS weekday, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year, CAST(weekofyear(date) AS INT) AS week_of_year,
  (dayofweek(date) + 1) % 7 + 1 IN (1, 2) AS is_weekend, {_EVENT.format('date')} AS event, CAST(day(date) <= 10 AS INT) AS snap FROM days),
dist AS (SELECT cal.*, CAST(date - (SELECT max(e.date) FROM cal e WHERE e.event IS NOT NULL AND e.date <= cal.date) AS INT) AS days_since_event,
  CAST((SELECT min(e.date) FROM cal e WHERE e.event IS NOT NULL AND e.date >= cal.date) - date AS INT) AS days_to_event FROM cal)"""
STRATA = FACT + f""",
last AS (SELECT max(date) AS last FROM fact),
items AS (SELECT item_id, dept_id, avg(CASE WHEN units = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zero_share FROM fact, last
  WHERE date BETWEEN last - {BT + S.STRATIFY_DAYS - 1} AND last - {BT} GROUP BY 1, 2 HAVING max(price) IS NOT NULL),
strata AS (SELECT *, CAST(ntile(3) OVER (PARTITION BY dept_id ORDER BY zero_share, item_id) AS INT) AS stratum FROM items),
named AS (SELECT *, CASE stratum WHEN 1 THEN 'dense' WHEN 2 THEN 'mid' WHEN 3 THEN 'sparse' END AS stratum_name FROM strata)"""


def _feature_columns() -> str:
    out = [f"lag(units, {H + k}) OVER w AS units_lag_{k}" for k in S.LAGS]
    for n in S.WINDOWS:
        frame = f"OVER (w ROWS BETWEEN {H + n - 1} PRECEDING AND {H} PRECEDING)"
        out += [f"round(avg(units) {frame}, 6) AS units_roll_mean_{n}", f"round(stddev_samp(units) {frame}, 6) AS units_roll_std_{n}", f"max(units) {frame} AS units_roll_max_{n}"]
    out += [
        f"round(avg(CASE WHEN units = 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (w ROWS BETWEEN {H + 89} PRECEDING AND {H} PRECEDING), 6) AS zero_share_90",
        f"CAST(date - max(CASE WHEN units > 0 THEN date END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND {H} PRECEDING) - {H} AS INT) AS days_since_last_sale",
        "round(price / nullif(avg(price) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 0), 6) AS price_rel_28", "price IS DISTINCT FROM lag(price, 1) OVER w AS price_changed", "price IS NOT NULL AS is_listed",
    ]
    return ", ".join(out)


FEATURES = CALENDAR + f""",
listed AS (SELECT item_id, store_id, min(date) AS first_listed_date FROM fact WHERE price IS NOT NULL GROUP BY 1, 2),
windows AS (SELECT date, item_id, store_id, dept_id, cat_id, state_id, units, price, {_feature_columns()} FROM fact WINDOW w AS (PARTITION BY item_id, store_id ORDER BY date)),
features AS (SELECT windows.*, {H} AS horizon, wday, weekday, month, year, week_of_year, is_weekend, event, snap, days_since_event, days_to_event
  FROM windows JOIN dist USING (date) JOIN listed USING (item_id, store_id) WHERE date >= first_listed_date)"""

ORACLES: dict[str, str] = {
    "fact_sales": f"WITH {FACT} SELECT * FROM fact",
    "panel_summary": f"""WITH {FACT} SELECT *, n_rows = n_series * n_dates AS rectangular FROM (SELECT count(*) AS n_rows, count(DISTINCT (item_id, store_id)) AS n_series, count(DISTINCT item_id) AS n_items, count(DISTINCT store_id) AS n_stores,
      count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date, round(avg(CASE WHEN units = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share, round(avg(CASE WHEN price IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS unpriced_share FROM fact)""",
    "dim_calendar": f"WITH {CALENDAR} SELECT * FROM cal",
    "calendar_features": f"WITH {CALENDAR} SELECT date, event, days_since_event, days_to_event FROM dist",
    "unpivot_sales": f"WITH {FACT} SELECT item_id, dept_id, store_id, strftime(date, '%Y-%m-%d') AS d, CAST(units AS BIGINT) AS units FROM fact",
    "item_stratum": f"WITH {STRATA} SELECT item_id, dept_id, round(zero_share, 6) AS zero_share, stratum, stratum_name FROM named",
    "stratum_summary": f"WITH {STRATA} SELECT dept_id, stratum, count(*) AS n_items, round(min(zero_share), 6) AS min_zero_share, round(avg(zero_share), 6) AS avg_zero_share, round(max(zero_share), 6) AS max_zero_share FROM strata GROUP BY 1, 2",
    "stratified_sample": f"""WITH {STRATA}, ranked AS (SELECT *, row_number() OVER (PARTITION BY dept_id, stratum ORDER BY md5(item_id || '#{S.SEED}'), item_id) <= CASE WHEN stratum <= 1 THEN 2 ELSE 1 END AS chosen FROM strata),
      counted AS (SELECT *, 4 - count(*) FILTER (chosen) OVER (PARTITION BY dept_id) AS short, row_number() OVER (PARTITION BY dept_id, chosen ORDER BY md5(item_id || '#{S.SEED}'), item_id) AS extra FROM ranked)
      SELECT dept_id, stratum, item_id, round(zero_share, 6) AS zero_share, NOT chosen AS topped_up FROM counted WHERE chosen OR extra <= short""",
    "sample_shortfall": f"WITH {STRATA} SELECT dept_id, 7 - count(*) AS shortfall FROM strata GROUP BY 1 HAVING count(*) < 7",
    "first_listed": f"WITH {FEATURES} SELECT * FROM listed",
    "feature_panel": f"WITH {FEATURES} SELECT * FROM features",
    "null_shares": f"WITH {FEATURES}, one AS (SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS {c}" for c in [
        *(f"units_lag_{k}" for k in S.LAGS), *(f"units_roll_{f}_{n}" for n in S.WINDOWS for f in ("mean", "std", "max")), "zero_share_90", "days_since_last_sale", "price_rel_28", "price_changed", "days_since_event", "days_to_event"]) + " FROM features) SELECT feature, round(null_share, 6) AS null_share FROM (UNPIVOT one ON * INTO NAME feature VALUE null_share)",
}

FOLDS = FACT + f""",
folds AS (SELECT fold, last - {H} * ({NF - 1} - fold) - {H} AS origin_date, last - {H} * ({NF - 1} - fold) - {H - 1} AS test_start, last - {H} * ({NF - 1} - fold) AS test_end
  FROM (SELECT max(date) AS last FROM fact), (SELECT CAST(unnest(range({NF})) AS INT) AS fold)),
targets AS (SELECT fold, origin_date, h AS horizon, origin_date + h AS target_date FROM folds, (SELECT CAST(unnest(range(1, {H + 1})) AS INT) AS h))"""
NAIVE = FOLDS + """,
naive AS (SELECT 'seasonal_naive' AS model_name, fold, origin_date, target_date, horizon, item_id, store_id, CAST(units AS DOUBLE) AS yhat
  FROM targets JOIN fact ON date = origin_date - 7 + (horizon - 1) % 7 + 1)"""
TSB = NAIVE + """,
numbered AS (SELECT date, item_id, store_id, units, row_number() OVER w AS n, count(*) FILTER (units > 0) OVER w AS k FROM fact WINDOW w AS (PARTITION BY item_id, store_id ORDER BY date)),
sized AS (SELECT *, max(n) OVER p AS n_all, max(k) OVER p AS k_all FROM numbered JOIN folds ON date <= origin_date WINDOW p AS (PARTITION BY fold, item_id, store_id)),
levels AS (SELECT fold, origin_date, item_id, store_id, sum(CASE WHEN units > 0 THEN pow(0.8::DOUBLE, n_all - n) * CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END ELSE 0 END) AS p,
  sum(CASE WHEN units > 0 THEN pow(0.8::DOUBLE, k_all - k) * CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END * units ELSE 0 END) AS z FROM sized GROUP BY ALL),
tsb AS (SELECT 'tsb' AS model_name, fold, levels.origin_date, target_date, horizon, item_id, store_id, p * z AS yhat FROM levels JOIN targets USING (fold))"""
SCORED = TSB + """,
forecasts AS (SELECT * FROM naive UNION ALL SELECT * FROM tsb),
changes AS (SELECT *, units - lag(units) OVER w AS change, min(CASE WHEN units > 0 THEN date END) OVER (PARTITION BY item_id, store_id) AS first FROM fact WINDOW w AS (PARTITION BY item_id, store_id ORDER BY date)),
raw AS (SELECT item_id, store_id, fold, avg(abs(change)) FILTER (date > first) AS scale, avg(change * change) FILTER (date > first) AS scale_sq FROM changes JOIN folds ON date <= origin_date GROUP BY 1, 2, 3),
scales AS (SELECT item_id, store_id, fold, CASE WHEN scale > 1e-12 THEN scale END AS scale, CASE WHEN scale_sq > 1e-12 THEN scale_sq END AS scale_sq FROM raw),
errors AS (SELECT f.*, CAST(units AS DOUBLE) AS y, yhat - units AS error FROM forecasts f JOIN fact a ON a.item_id = f.item_id AND a.store_id = f.store_id AND a.date = target_date)"""


def _score(by: str, source: str = "errors") -> str:
    extra = f", {by}" if by else ""
    return f"""one AS (SELECT model_name, fold, item_id, store_id{extra}, avg(abs(error)) / max(scale) AS mase, sqrt(avg(error * error) / max(scale_sq)) AS rmsse, avg(error) AS bias
      FROM {source} LEFT JOIN scales USING (item_id, store_id, fold) GROUP BY model_name, fold, item_id, store_id{extra}),
    long AS (SELECT model_name, fold{extra}, unnest(['mase', 'rmsse', 'bias']) AS metric, unnest([mase, rmsse, bias]) AS value FROM one),
    metrics AS (SELECT model_name, fold{extra}, metric, avg(value) AS value, count(value) AS n_series, count(*) - count(value) AS n_excluded FROM long GROUP BY ALL)"""


_METRICS = "SELECT * REPLACE (round(value, 6) AS value) FROM metrics"
_LEVELS = "[" + ", ".join(f"{q}::DOUBLE" for q in S.LEVELS) + "]"
QUANTILES = SCORED + f""",
weekly AS (SELECT date, item_id, store_id, units - lag(units, 7) OVER (PARTITION BY item_id, store_id ORDER BY date) AS residual FROM fact),
offsets AS (SELECT fold, item_id, store_id, quantile_cont(CAST(residual AS DOUBLE), {_LEVELS}) AS o FROM weekly JOIN folds ON date <= origin_date WHERE residual IS NOT NULL GROUP BY 1, 2, 3),
quantiles AS (SELECT model_name, fold, origin_date, target_date, horizon, item_id, store_id, unnest({_LEVELS}) AS quantile, unnest(list_transform(o, lambda x: greatest(0.0::DOUBLE, yhat + x))) AS yhat
  FROM naive JOIN offsets USING (fold, item_id, store_id)),
crossed AS (SELECT * REPLACE (yhat * CASE WHEN quantile = 0.75::DOUBLE AND horizon % 4 = 0 THEN 1.5::DOUBLE ELSE 1 END AS yhat) FROM quantiles)"""
_ALPHAS = (0.1, 0.15, 0.2, 0.25, 0.3)


def _ses(values: str) -> str:
    tried = ", ".join(
        f"list_reduce({values}, lambda a, x: {{'sse': a.sse + (x - a.level) * (x - a.level), 'alpha': a.alpha, 'level': a.alpha * x + (1 - a.alpha) * a.level}}, {{'sse': 0.0::DOUBLE, 'alpha': {a}::DOUBLE, 'level': {values}[1]}})"
        for a in _ALPHAS
    )
    return f"list_min([{tried}]).level"


ORACLES |= {
    "folds": f"WITH {FOLDS} SELECT * FROM folds",
    "seasonal_naive": f"WITH {NAIVE} SELECT * FROM naive",
    "tsb_forecast": f"WITH {TSB} SELECT * REPLACE (round(yhat, 6) AS yhat) FROM tsb",
    "croston_forecast": f"""WITH {NAIVE}, numbered AS (SELECT *, row_number() OVER (PARTITION BY item_id, store_id ORDER BY date) AS n FROM fact),
      gaps AS (SELECT date, item_id, store_id, CAST(units AS DOUBLE) AS units, CAST(n - coalesce(lag(n) OVER (PARTITION BY item_id, store_id ORDER BY date), 0) AS DOUBLE) AS gap FROM numbered WHERE units > 0),
      lists AS (SELECT fold, origin_date, item_id, store_id, list(units ORDER BY date) AS u, list(gap ORDER BY date) AS g FROM gaps JOIN folds ON date <= origin_date GROUP BY ALL)
      SELECT 'croston' AS model_name, fold, lists.origin_date, target_date, horizon, item_id, store_id, round({_ses('u')} / {_ses('g')}, 6) AS yhat FROM lists JOIN targets USING (fold)""",
    "naive_scales": f"WITH {SCORED} SELECT item_id, store_id, fold, round(scale, 6) AS scale, round(scale_sq, 6) AS scale_sq FROM scales",
    "fold_metrics": f"WITH {SCORED}, {_score('')} {_METRICS}",
    "metrics_by_horizon": f"WITH {SCORED}, {_score('horizon')} {_METRICS}",
    "metrics_by_stratum": f"WITH {SCORED}, {STRATA.removeprefix(FACT + ',')}, banded AS (SELECT errors.*, stratum_name AS stratum FROM errors LEFT JOIN named USING (item_id)), {_score('stratum', 'banded')} {_METRICS}",
    "horizon_decay": f"WITH {SCORED}, {_score('horizon')} SELECT model_name, metric, CAST((horizon - 1) // 7 + 1 AS BIGINT) AS week, round(avg(value), 6) AS value FROM metrics GROUP BY ALL",
    "fold_summary": f"WITH {SCORED}, {_score('')} SELECT model_name, metric, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, count(value) AS n_folds FROM metrics GROUP BY ALL",
    "quantile_forecast": f"WITH {QUANTILES} SELECT * REPLACE (round(yhat, 6) AS yhat) FROM quantiles",
    "monotone_quantiles": f"""WITH {QUANTILES}, lists AS (SELECT model_name, fold, item_id, store_id, target_date, origin_date, horizon, list(quantile ORDER BY quantile) AS q, list(yhat ORDER BY yhat) AS v FROM crossed GROUP BY ALL)
      SELECT model_name, fold, item_id, store_id, target_date, origin_date, horizon, unnest(q) AS quantile, unnest(list_transform(v, lambda x: round(x, 6))) AS yhat FROM lists""",
    "crossing_rate": f"""WITH {QUANTILES}, steps AS (SELECT *, yhat - lag(yhat) OVER (PARTITION BY model_name, fold, item_id, store_id, target_date ORDER BY quantile) < -1e-9 AS c FROM crossed),
      flagged AS (SELECT model_name, fold, item_id, store_id, target_date, coalesce(bool_or(c), false) AS c FROM steps GROUP BY ALL)
      SELECT model_name, count(*) AS n_rows, count(*) FILTER (c) AS n_crossing, round(count(*) FILTER (c) / count(*), 6) AS rate FROM flagged GROUP BY 1""",
    "pinball_scores": f"""WITH {QUANTILES} SELECT model_name, fold, quantile, round(avg(greatest(quantile * (units - yhat), (quantile - 1) * (units - yhat))), 6) AS value, count(*) AS n_rows, 'pinball_q' || CAST(quantile AS VARCHAR) AS metric
      FROM quantiles q JOIN fact a ON a.item_id = q.item_id AND a.store_id = q.store_id AND a.date = target_date GROUP BY 1, 2, 3""",
    "hybrid_forecast": f"""WITH {SCORED}, {STRATA.removeprefix(FACT + ',')} SELECT 'hybrid' AS model_name, fold, origin_date, target_date, horizon, item_id, store_id, round(yhat, 6) AS yhat, model_name AS source_model
      FROM forecasts JOIN named USING (item_id) WHERE model_name = CASE stratum_name WHEN 'sparse' THEN 'tsb' ELSE 'seasonal_naive' END""",
}

# Margin, spoilage and holding of the standard cost model.
_M, _S, _HOLD = 0.3, 0.6, 0.02


def _ratio(spoilage: float) -> float:
    return _M / (_M + (1 - _M) * (spoilage + _HOLD))


def _interpolate(target: float) -> str:
    k = next(i for i, q in enumerate(S.LEVELS) if q >= target)
    if S.LEVELS[k] == target:
        return f"q[{k + 1}]"
    w = (target - S.LEVELS[k - 1]) / (S.LEVELS[k] - S.LEVELS[k - 1])
    return f"(q[{k}] + {w!r}::DOUBLE * (q[{k + 1}] - q[{k}]))"


def _masses() -> list[float]:
    edges = [0.0, *((a + b) / 2 for a, b in zip(S.LEVELS[:-1], S.LEVELS[1:], strict=True)), 1.0]
    return [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]


PANEL = QUANTILES + f""",
panel AS (SELECT model_name, fold, w.item_id, w.store_id, target_date, q, CAST(a.units AS DOUBLE) AS demand, coalesce(a.price, 3.0::DOUBLE) AS price, coalesce(CAST(b.units AS DOUBLE), 0) AS naive,
    greatest(0.0::DOUBLE, {_interpolate(_ratio(_S))}) AS order_qty
  FROM (SELECT model_name, fold, item_id, store_id, target_date, list(yhat ORDER BY yhat) AS q FROM quantiles GROUP BY ALL) w
  JOIN fact a ON a.item_id = w.item_id AND a.store_id = w.store_id AND a.date = target_date
  LEFT JOIN fact b ON b.item_id = w.item_id AND b.store_id = w.store_id AND b.date = target_date - 7),
policy AS (SELECT model_name, fold, item_id, store_id, target_date, price, price * {_M}::DOUBLE AS cu, price * {1 - _M!r}::DOUBLE * {_S + _HOLD!r}::DOUBLE AS co, {_ratio(_S)!r}::DOUBLE AS critical_ratio, order_qty, demand, q FROM panel),
policy2 AS (SELECT * EXCLUDE (q), """ + " + ".join(f"{m!r}::DOUBLE * (greatest(q[{i}] - order_qty, 0) * cu + greatest(order_qty - q[{i}], 0) * co)" for i, m in enumerate(_masses(), 1)) + " AS expected_cost FROM policy)"


def _stack(**policies: str) -> str:
    return "stacked AS (" + " UNION ALL ".join(f"SELECT '{k}' AS policy, CAST({v} AS DOUBLE) AS q, demand, price FROM panel" for k, v in policies.items()) + ")"


_SIMULATED = f"""parts AS (SELECT policy, greatest(demand - q, 0) AS s, greatest(q - demand, 0) AS l, price FROM stacked),
  simulated AS (SELECT policy, avg(CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0 END) AS stockout_rate, sum(s) AS units_short, sum(l) AS units_left, sum(s * price * {_M}::DOUBLE) AS understock_cost,
    sum(l * price * {1 - _M!r}::DOUBLE * {_S}::DOUBLE) AS waste_cost, sum(l * price * {1 - _M!r}::DOUBLE * {_HOLD}::DOUBLE) AS holding_cost, count(*) AS n_rows FROM parts GROUP BY 1),
  totals AS (SELECT *, understock_cost + waste_cost + holding_cost AS total_cost FROM simulated)"""
_ROUND_COST = ", ".join(f"round({c}, 2) AS {c}" for c in ("understock_cost", "waste_cost", "holding_cost", "total_cost"))


def _sensitivity() -> str:
    cells = []
    for s in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0):
        for name, q in (("naive", "naive"), ("fixed_95", "q[6]"), ("newsvendor", f"greatest(0.0::DOUBLE, {_interpolate(_ratio(s))})")):
            cells.append(f"SELECT {s}::DOUBLE AS spoilage, {_ratio(s)!r}::DOUBLE AS critical_ratio, '{name}' AS policy, CAST({q} AS DOUBLE) AS o, demand, price FROM panel")
    return "cells AS (" + " UNION ALL ".join(cells) + ")"


_PATHS = ["state_id", "state_id || '/' || store_id", "state_id || '/' || store_id || '/' || dept_id", "state_id || '/' || store_id || '/' || dept_id || '/' || item_id"]
_NAMES = ["state", "store", "dept", "item"]
NODES = TSB + ",\nacts AS (" + " UNION ALL ".join(f"SELECT {p} AS node, '{n}' AS level, date, CAST(sum(units) AS BIGINT) AS units FROM fact GROUP BY 1, 2, 3" for p, n in zip(_PATHS, _NAMES, strict=True)) + """),
paths AS (SELECT DISTINCT item_id, store_id, """ + _PATHS[3] + """ AS node FROM fact)"""
TREE = NODES + """,
base AS (SELECT node, level, fold, target_date, CAST(units AS DOUBLE) AS yhat FROM targets JOIN acts ON date = origin_date - 7 + (horizon - 1) % 7 + 1 WHERE level <> 'item'
  UNION ALL SELECT node, 'item', fold, target_date, yhat FROM tsb JOIN paths USING (item_id, store_id))"""
_P = "regexp_replace(node, '/[^/]*$', '')"
RECONCILED = """,
up_item AS (SELECT node, fold, target_date, yhat, yhat AS z, 1.0::DOUBLE AS s, 1.0::DOUBLE AS leaves, NULL::DOUBLE AS c, NULL::DOUBLE AS cs FROM base WHERE level = 'item'),""" + ",".join(f"""
up_{n} AS (SELECT *, s * (yhat / leaves + c / cs) AS z FROM (SELECT b.node, b.fold, b.target_date, b.yhat, leaves, c, cs, 1 / (1 / leaves + 1 / cs) AS s FROM base b
  JOIN (SELECT {_P} AS node, fold, target_date, sum(z) AS c, sum(s) AS cs, sum(leaves) AS leaves FROM up_{below} GROUP BY 1, 2, 3) k USING (node, fold, target_date)))""" for n, below in zip(_NAMES[2::-1], _NAMES[:0:-1], strict=True)) + """,
down_state AS (SELECT *, z AS y FROM up_state)""" + "".join(f""",
down_{n} AS (SELECT u.*, u.z + u.s / p.cs * (p.y - p.c) AS y FROM up_{n} u JOIN down_{above} p ON p.node = {_P.replace('node', 'u.node')} AND p.fold = u.fold AND p.target_date = u.target_date)""" for above, n in zip(_NAMES[:-1], _NAMES[1:], strict=True)) + """,
reconciled AS (""" + " UNION ALL ".join(f"SELECT node, '{n}' AS level, 'mixed' AS model_name, fold, target_date, yhat, y AS reconciled, greatest(0.0::DOUBLE, y) AS clipped FROM down_{n}" for n in _NAMES) + ")"
MINT = TREE + RECONCILED


def _gap(value: str) -> str:
    return f"""(SELECT p.model_name, p.fold, p.level AS parent_level, k.child_level, avg(abs(p.{value} - k.x)) AS mean_abs_gap, max(abs(p.{value} - k.x)) AS max_abs_gap, count(*) AS n_checked FROM reconciled p
      JOIN (SELECT {_P} AS node, fold, target_date, sum({value}) AS x, max(level) AS child_level FROM reconciled WHERE contains(node, '/') GROUP BY 1, 2, 3) k USING (node, fold, target_date) GROUP BY 1, 2, 3, 4)"""


LEVEL_SCORES = MINT + """,
node_changes AS (SELECT node, level, date, units, units - lag(units) OVER (PARTITION BY node ORDER BY date) AS change, min(CASE WHEN units > 0 THEN date END) OVER (PARTITION BY node) AS first FROM acts),
node_scales AS (SELECT node, fold, avg(change * change) FILTER (date > first) AS scale_sq FROM node_changes JOIN folds ON date <= origin_date GROUP BY 1, 2),
node_errors AS (SELECT node, level, fold, 'base' AS model_name, yhat - units AS error FROM reconciled JOIN acts USING (node, level) WHERE date = target_date
  UNION ALL SELECT node, level, fold, 'reconciled', reconciled - units FROM reconciled JOIN acts USING (node, level) WHERE date = target_date),
node_scores AS (SELECT node, level, fold, model_name, sqrt(avg(error * error) / max(CASE WHEN scale_sq > 1e-12 THEN scale_sq END)) AS rmsse FROM node_errors LEFT JOIN node_scales USING (node, fold) GROUP BY ALL),
revenue AS (SELECT node, level, sum(r) AS revenue FROM (""" + " UNION ALL ".join(f"SELECT {p} AS node, '{n}' AS level, units * coalesce(price, 0) AS r FROM fact WHERE date > (SELECT max(date) FROM fact) - 28" for p, n in zip(_PATHS, _NAMES, strict=True)) + """) GROUP BY 1, 2),
weights AS (SELECT node, level, revenue / nullif(sum(revenue) OVER (PARTITION BY level), 0) / 4 AS weight FROM revenue)"""

ORACLES |= {
    "order_policy": f"WITH {PANEL} SELECT * EXCLUDE (expected_cost) REPLACE (round(critical_ratio, 6) AS critical_ratio, round(order_qty, 6) AS order_qty) FROM policy2",
    "money_table": f"WITH {PANEL}, {_stack(naive='naive', fixed_95='q[6]', newsvendor='order_qty')}, {_SIMULATED} SELECT policy, round(stockout_rate, 6) AS stockout_rate, round(units_short, 6) AS units_short, round(units_left, 6) AS units_left, {_ROUND_COST}, n_rows, round((n.t - total_cost) / nullif(n.t, 0), 6) AS saving_vs_naive FROM totals, (SELECT total_cost AS t FROM totals WHERE policy = 'naive') n",
    "cost_sensitivity": f"WITH {PANEL}, {_sensitivity()}, summed AS (SELECT spoilage, policy, max(critical_ratio) AS critical_ratio, sum(greatest(demand - o, 0) * price * {_M}::DOUBLE + greatest(o - demand, 0) * price * {1 - _M!r}::DOUBLE * (spoilage + {_HOLD}::DOUBLE)) AS total_cost FROM cells GROUP BY 1, 2) SELECT spoilage, policy, round(critical_ratio, 6) AS critical_ratio, round(total_cost, 2) AS total_cost, round((first_value(total_cost) OVER (PARTITION BY spoilage ORDER BY policy <> 'naive') - total_cost) / nullif(first_value(total_cost) OVER (PARTITION BY spoilage ORDER BY policy <> 'naive'), 0), 6) AS saving_vs_naive FROM summed",
    "attribution": f"WITH {PANEL}, ratio AS (SELECT avg(order_qty + 1e-9::DOUBLE) / avg(q[3] + 1e-9::DOUBLE) AS ratio FROM panel), " + _stack(**{"naive|as_forecast": "naive", "naive|newsvendor": "naive * (SELECT ratio FROM ratio)", "model|as_forecast": "q[3]", "model|newsvendor": "order_qty"}) + f", {_SIMULATED} SELECT split_part(policy, '|', 1) AS forecast, split_part(policy, '|', 2) AS rule, round(total_cost, 2) AS total_cost, round((max(total_cost) OVER () - total_cost) / nullif(max(total_cost) OVER (), 0), 6) AS saving_vs_worst FROM totals",
    "service_level_sweep": f"WITH {PANEL}, swept AS (" + " UNION ALL ".join(f"SELECT {r}::DOUBLE AS critical_ratio, {_interpolate(r)} AS o, demand FROM panel" for r in (round(0.1 + i / 100, 2) for i in range(90))) + ") SELECT critical_ratio, round(sum(greatest(demand - o, 0)), 6) AS units_short, round(sum(greatest(o - demand, 0)), 6) AS units_left, round(avg(CASE WHEN demand - o > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS stockout_rate FROM swept GROUP BY 1",
    "optimize_item": f"WITH {PANEL} SELECT item_id, target_date, round(sum(order_qty), 4) AS order_qty, sum(demand) AS demand, round(sum(expected_cost), 2) AS expected_cost, count(*) AS n_stores FROM policy2 WHERE item_id = 'Brand#1' AND fold = (SELECT max(fold) FROM policy2 WHERE item_id = 'Brand#1') GROUP BY 1, 2",
    "hierarchy_actuals": f"WITH {TREE} SELECT * FROM acts",
    "hierarchy_weights": f"WITH {LEVEL_SCORES} SELECT node, level, round(weight, 6) AS weight FROM weights",
    "mint_reconcile": f"WITH {MINT} SELECT * REPLACE (round(yhat, 6) AS yhat, round(reconciled, 6) AS reconciled, round(clipped, 6) AS clipped) FROM reconciled",
    "coherence_gap": f"WITH {MINT}, gaps AS (SELECT *, false AS reconciled FROM {_gap('yhat')} UNION ALL SELECT *, true AS reconciled FROM {_gap('reconciled')}) SELECT * REPLACE (round(mean_abs_gap, 4) AS mean_abs_gap, round(max_abs_gap, 4) AS max_abs_gap) FROM gaps",
    "wrmsse": f"WITH {LEVEL_SCORES} SELECT model_name, fold, round(sum(rmsse * weight), 6) AS wrmsse, count(rmsse) AS n_series, count(*) - count(rmsse) AS n_excluded FROM node_scores JOIN weights USING (node) GROUP BY 1, 2",
    "level_comparison": f"WITH {LEVEL_SCORES}, two AS (SELECT level, avg(rmsse) FILTER (model_name = 'base') AS base, avg(rmsse) FILTER (model_name = 'reconciled') AS reconciled FROM node_scores GROUP BY 1) SELECT level, round(base, 6) AS base, round(reconciled, 6) AS reconciled, round(reconciled - base, 6) AS delta, CASE WHEN reconciled < base THEN 'better' WHEN reconciled > base THEN 'worse' ELSE 'equal' END AS verdict FROM two",
    "hierarchy_tree": f"WITH {FACT}, i AS (SELECT state_id, store_id, dept_id, item_id, CAST(sum(units) AS BIGINT) AS units FROM fact GROUP BY ALL), d AS (SELECT state_id, store_id, dept_id, CAST(sum(units) AS BIGINT) AS units, string_agg(item_id || ':' || units, ',' ORDER BY item_id) AS items FROM i GROUP BY 1, 2, 3) SELECT state_id, store_id, CAST(sum(units) AS BIGINT) AS units, string_agg(dept_id || ':' || units || '(' || items || ')', ';' ORDER BY dept_id) AS depts FROM d GROUP BY 1, 2",
}

from larder.operators import service as _service  # noqa: E402  (its fixed values)
from larder.sources.rules import RULES as _RULES  # noqa: E402

A = 14
#: What to keep in mind where few folds were measured.
CAVEAT = "CASE WHEN {0} <= 0 THEN 'Nothing could be measured on its own history.' WHEN {0} = 1 THEN 'One fold alone was measured, which may be luck.' WHEN {0} = 2 THEN 'Two folds alone were measured, so the figures are rough.' END"
UPLOAD = DAILY + """,
upload AS (SELECT event_type AS sku, CAST(ts AS DATE) AS date, value AS units_sold, NULL::DOUBLE AS unit_price FROM events
  UNION ALL SELECT item_id, date, CAST(units AS DOUBLE), cents / 100.0::DOUBLE / units FROM daily),
merged AS (SELECT sku, date, sum(CASE WHEN units_sold < 0 THEN 0 ELSE units_sold END) AS units_sold FROM upload WHERE date IS NOT NULL AND sku IS NOT NULL AND sku <> '' GROUP BY 1, 2),
dense AS (SELECT g.sku, g.date, units_sold FROM (SELECT sku, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM merged GROUP BY sku) g LEFT JOIN merged USING (sku, date)),
brands AS (SELECT sku, date, round(units_sold, 6) AS units_sold FROM dense),
gaps AS (SELECT *, date - lag(date) OVER (PARTITION BY sku ORDER BY date) - 1 AS gap FROM merged),
spans AS (SELECT sku, CAST(max(date) - min(date) + 1 AS INT) AS n_days, count(*) AS n_obs, count(units_sold) AS n_nonnull, min(date) AS first_date, max(date) AS last_date, CAST(coalesce(max(gap), 0) AS INT) AS max_gap_days FROM gaps GROUP BY 1),
verdicts AS (SELECT *, concat_ws('; ', CASE WHEN n_days < 90 THEN 'its history spans ' || n_days || ' days, under the least of 90' END,
    CASE WHEN n_nonnull < 20 THEN n_nonnull || ' days have an amount, under the least of 20' || CASE WHEN n_obs <> n_nonnull THEN ' (in ' || n_obs || ' rows)' ELSE '' END END,
    CASE WHEN max_gap_days > 14 THEN 'nothing was recorded for ' || max_gap_days || ' days on end, over the most of 14' END) AS reasons FROM spans)"""


def _origin() -> str:
    v = "units_sold"
    out = [f"lag({v}, {k - 1}) OVER w AS lag_{k}" for k in _service.LAGS]
    for n in _service.WINDOWS:
        f, least = f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)", max(2, n // 4)
        out += [
            f"CASE WHEN count({v}) {f} >= {least} THEN round(avg({v}) {f}, 6) END AS mean_{n}", f"CASE WHEN count({v}) {f} >= {least} THEN round(stddev_samp({v}) {f}, 6) END AS std_{n}",
            f"CASE WHEN count(*) {f} >= {least} THEN round(avg(CASE WHEN {v} = 0 THEN 1.0::DOUBLE ELSE 0 END) {f}, 6) END AS zero_{n}",
        ]
    out += ["row_number() OVER w - 1 AS trend", f"CASE WHEN {v} IS NOT NULL THEN round(avg({v}) OVER (PARTITION BY sku, dayofweek(date), {v} IS NOT NULL ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) END AS same_weekday_4"]
    return ", ".join(out)


_FEASTS = ", ".join(f"('{k}', '{n}', {m}, {d}, {a}, {b}, {str(p).lower()})" for k, (n, m, d, a, b, p) in _service.FESTIVALS.items())
# Days of moving festivals in the years of the data, as public holiday lists of India give them; the almanac must agree.
KNOWN_DAYS = {
    "diwali": ("1995-10-23", "1996-11-10", "1997-10-30", "1998-10-19", "1999-11-07", "2000-10-26", "2001-11-14"), "holi": ("1995-03-17", "1996-03-05", "1997-03-24", "1998-03-13", "1999-03-02", "2000-03-20", "2001-03-10"),
    "maha_shivaratri": ("1995-02-27", "1996-02-17", "1997-03-07", "1998-02-25", "1999-02-14", "2000-03-04", "2001-02-21"), "raksha_bandhan": ("1995-08-10", "1996-08-28", "1997-08-18", "1998-08-08", "1999-08-26", "2000-08-15", "2001-08-04"),
    "eid_al_fitr": ("1995-03-03", "1996-02-21", "1997-02-09", "1998-01-30", "1999-01-19", "2000-01-08", "2000-12-28", "2001-12-17"),
}
_MOVING = ", ".join(f"('{k}', '{_service.MOVING[k][0]}', DATE '{d}', {_service.MOVING[k][1]}, {_service.MOVING[k][2]})" for k, days in KNOWN_DAYS.items() for d in days)
FEASTS = f"""feast_days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily),
feasts AS (SELECT key, name, make_date(year, m, d) AS day, make_date(year, m, d) - a AS window_start, make_date(year, m, d) + b AS window_end, prior_only
  FROM (SELECT DISTINCT year(date) AS year FROM feast_days), (VALUES {_FEASTS}) AS t(key, name, m, d, a, b, prior_only)
  UNION ALL SELECT key, name, day, day - a, day + b, false FROM (VALUES {_MOVING}) AS t(key, name, day, a, b) WHERE year(day) IN (SELECT year(date) FROM feast_days))"""
OCCURRENCES = UPLOAD + ", " + FEASTS + """,
near AS (SELECT b.sku, b.date, units_sold AS v, f.*, b.date >= window_start AND b.date < day AS lead, b.date BETWEEN day AND window_end AS tail FROM {series} b JOIN feasts f ON NOT prior_only AND b.date BETWEEN window_start - 31 AND window_end + 31 WHERE units_sold IS NOT NULL),
based AS (SELECT *, (date < window_start - 3 OR date > window_end + 3) AND bool_or(lead) OVER (PARTITION BY sku, key, day, dayofweek(date)) AS base FROM near),
occasions AS (SELECT sku, key, name, day, avg(v) FILTER (lead) AS lead_mean, avg(v) FILTER (base) AS baseline_mean, count(*) FILTER (lead) AS n_lead, count(*) FILTER (base) AS n_base, count(*) FILTER (tail AND v = 0) AS closed FROM based GROUP BY ALL),
effects AS (SELECT sku, key, name, median(lead_mean / baseline_mean) AS multiplier, min(lead_mean / baseline_mean) AS low, max(lead_mean / baseline_mean) AS high, count(*) AS years, sum(closed) > 0 AS shut_on_day
  FROM occasions WHERE n_lead >= 3 AND n_base >= 6 AND baseline_mean > 0 GROUP BY ALL)"""
_NAMES_SQL = ", ".join(f"('{x}')" for x in ["Amul Milk 1L", "Plum Cake 500g", "Oil Lamp brass", "Holi Colours (gift pack)", "Chicken eggs", "National Flag, paper flag", "Dry Fruit Box 1kg", "soft drinks 2x", "Dates & milk", "unknown"])
_TOKENS = "' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' '"
MATCHES = f"""skus AS (SELECT DISTINCT p_brand AS sku FROM part UNION ALL SELECT * FROM (VALUES {_NAMES_SQL})),
rules AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', '{d}', '{c}', {m}::DOUBLE, '{items}')" for i, (k, d, c, m, items) in enumerate(_RULES))}) AS t(n, festival_key, direction, category, multiplier, items)),
phrases AS (SELECT n, festival_key, direction, category, multiplier, unnest(range(len(string_split(items, ',')))) AS nth, trim(unnest(string_split(items, ','))) AS keyword FROM rules),
hits AS (SELECT sku, p.*, length(replace({_TOKENS.format('keyword')}, ' ', '')) AS size FROM skus JOIN phrases p ON length(trim({_TOKENS.format('keyword')})) >= {_service.MIN_KEYWORD} AND contains({_TOKENS.format('sku')}, {_TOKENS.format('keyword')})),
best AS (SELECT * FROM hits QUALIFY size = max(size) OVER (PARTITION BY sku, festival_key)),
agreed AS (SELECT sku, festival_key, arg_min(keyword, n * 1000 + nth) AS keyword, arg_min(category, n * 1000 + nth) AS category, arg_min(multiplier, n * 1000 + nth) AS multiplier FROM best GROUP BY 1, 2 HAVING min(direction) = max(direction))"""
TOTALS = UPLOAD + f""",
sums AS (SELECT sku, units_sold, CASE WHEN count(*) OVER f = {A} THEN sum(units_sold) OVER f END AS total FROM brands WHERE units_sold IS NOT NULL WINDOW f AS (PARTITION BY sku ORDER BY date ROWS BETWEEN CURRENT ROW AND {A - 1} FOLLOWING)),
totals AS (SELECT sku, coalesce(quantile_cont(total, {_LEVELS}), list_transform({_LEVELS}, lambda x: avg(units_sold) * {A})) AS q FROM sums GROUP BY 1),
prices AS (SELECT sku, max_by(unit_price, date) AS p FROM (SELECT sku, date, max(unit_price) AS unit_price FROM upload GROUP BY 1, 2) WHERE unit_price > 0 GROUP BY 1)"""

ORACLES |= {
    "gate_verdicts": f"WITH {UPLOAD} SELECT *, reasons = '' AS admitted FROM verdicts",
    "gate_report": f"WITH {UPLOAD} SELECT count(*) AS rows_read, count(*) FILTER (date IS NULL) AS rows_without_date, count(*) FILTER (date IS NOT NULL AND sku <> '') AS rows_used, count(*) FILTER (units_sold < 0) AS negative_units, count(*) FILTER (date IS NOT NULL AND sku <> '') - (SELECT count(*) FROM merged) AS rows_merged, CAST(NULL AS VARCHAR) AS fatal FROM upload",
    "daily_densify": f"WITH {UPLOAD} SELECT sku, date, round(units_sold, 6) AS units_sold FROM dense",
    "origin_features": f"WITH {UPLOAD} SELECT sku, date, units_sold, {_origin()} FROM brands WINDOW w AS (PARTITION BY sku ORDER BY date)",
    "total_ahead": f"WITH {UPLOAD}, ahead AS (SELECT *, CASE WHEN count(units_sold) OVER f = {A} THEN sum(units_sold) OVER f END AS y, row_number() OVER (PARTITION BY sku ORDER BY date DESC) - 1 AS back, count(*) OVER (PARTITION BY sku) AS n FROM brands WINDOW f AS (PARTITION BY sku ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {A} FOLLOWING)) SELECT sku, date, units_sold, round(y, 6) AS y FROM ahead WHERE back % greatest(CAST(ceil(n * {A} / 8000.0) AS BIGINT), 1) = 0",
    "baseline_totals": f"WITH {TOTALS} SELECT sku, CAST(unnest(range(7)) AS INT) AS k, round(greatest(unnest(q), 0), 6) AS value FROM totals",
    "service_orders": f"WITH {TOTALS}, o AS (SELECT sku, coalesce(p, 3.0::DOUBLE) AS price, list_transform(q, lambda x: greatest(x, 0)) AS q FROM totals LEFT JOIN prices USING (sku)), w AS (SELECT *, greatest(0.0::DOUBLE, {_interpolate(_ratio(_S))}) AS order_qty FROM o) SELECT sku, price, round(order_qty, 6) AS order_qty, round(" + " + ".join(f"{m!r}::DOUBLE * (greatest(q[{i}] - order_qty, 0) * price * {_M}::DOUBLE + greatest(order_qty - q[{i}], 0) * price * {1 - _M!r}::DOUBLE * {_S + _HOLD!r}::DOUBLE)" for i, m in enumerate(_masses(), 1)) + ", 2) AS expected_cost FROM w",
    "resolve_price": f"WITH {TOTALS} SELECT sku, coalesce(p, 3.0::DOUBLE) AS price, p IS NULL AS assumed FROM (SELECT DISTINCT sku FROM upload) LEFT JOIN prices USING (sku)",
    "choose_method": f"WITH {SCORED}, losses AS (SELECT item_id AS sku, model_name, greatest({_ratio(_S)!r}::DOUBLE * -error, {_ratio(_S) - 1!r}::DOUBLE * -error) AS loss FROM errors), two AS (SELECT sku, avg(loss) FILTER (model_name = 'tsb') AS model, avg(loss) FILTER (model_name = 'seasonal_naive') AS baseline FROM losses GROUP BY 1), judged AS (SELECT *, abs(model - baseline) / greatest(abs(model), abs(baseline), 1e-9) < 0.05 AS close FROM two) SELECT sku, round(model, 6) AS model, round(baseline, 6) AS baseline, CASE WHEN close OR baseline < model THEN 'baseline' ELSE 'model' END AS method, CASE WHEN close THEN 'too close to call' WHEN baseline < model THEN 'the baseline was better' ELSE 'the model was better' END AS reason FROM judged",
    "fold_counts": f"WITH {UPLOAD}, n AS (SELECT sku, n_days, CAST(greatest(0, least(5, floor((n_days - 28) / {A}))) AS INT) AS n_folds FROM spans) SELECT *, {CAVEAT.format('n_folds')} AS caveat FROM n",
    "festival_windows": f"WITH {DAILY}, {FEASTS} SELECT date, key, CAST(abs(date - day) AS INT) AS distance FROM feast_days JOIN feasts ON date BETWEEN window_start AND window_end QUALIFY row_number() OVER (PARTITION BY date ORDER BY abs(date - day), prior_only, key) = 1",
    "festival_proximity": f"WITH {DAILY}, {FEASTS} SELECT date, CAST(least(coalesce((SELECT min(day) FROM feasts WHERE day >= date) - date, 45), 45) AS INT) AS days_to_next, CAST(least(coalesce(date - (SELECT max(day) FROM feasts WHERE day <= date), 45), 45) AS INT) AS days_since_last, CAST(EXISTS (SELECT 1 FROM feasts WHERE date BETWEEN window_start AND window_end) AS INT) AS in_window FROM feast_days",
    "festival_uplift": "WITH " + OCCURRENCES.format(series="brands") + " SELECT sku, key, name, round(multiplier, 6) AS multiplier, round(low, 6) AS low, round(high, 6) AS high, years, shut_on_day FROM effects",
    "keyword_match": f"WITH {MATCHES} SELECT * FROM agreed",
    "keyword_coverage": f"WITH {MATCHES}, k AS (SELECT sku, string_agg(DISTINCT festival_key, ',' ORDER BY festival_key) AS festivals FROM agreed GROUP BY 1) SELECT sku, festivals, festivals IS NOT NULL AS matched FROM (SELECT DISTINCT sku FROM skus) LEFT JOIN k USING (sku)",
    "festival_plan": "WITH " + OCCURRENCES.format(series="(SELECT * FROM brands WHERE date <= DATE '2000-12-10')") + f""", lasts AS (SELECT sku, max(date) AS last FROM brands WHERE date <= DATE '2000-12-10' GROUP BY 1), ahead AS (SELECT sku, last, last + h AS date FROM lasts, (SELECT CAST(unnest(range(1, {A + 1})) AS INT) AS h)),
      owned AS (SELECT a.sku, a.date, multiplier FROM ahead a JOIN effects e USING (sku) JOIN feasts f ON f.key = e.key AND a.date >= window_start AND a.date < day QUALIFY row_number() OVER (PARTITION BY a.sku, a.date ORDER BY abs(a.date - day), prior_only, f.key) = 1),
      summed AS (SELECT sku, last, avg(coalesce(multiplier, 1)) AS factor, count(multiplier) AS days_adjusted FROM ahead LEFT JOIN owned USING (sku, date) GROUP BY 1, 2)
      SELECT sku, round(factor, 6) AS factor, days_adjusted, CASE WHEN days_adjusted > 0 THEN 'adjusted' WHEN EXISTS (SELECT 1 FROM feasts WHERE window_start <= last + {A + 14} AND window_end > last) THEN 'advisory' ELSE 'none' END AS state, abs(factor - 1) >= 0.01 AS material FROM summed""",
    "retention": "SELECT l_returnflag, count(*) AS n_orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS TIMESTAMP) >= TIMESTAMP '2001-01-01' - INTERVAL 730 DAY) GROUP BY 1",
    "newest_rows": f"WITH {DAILY}, d AS (SELECT item_id, date, CAST(sum(units) AS BIGINT) AS units FROM daily GROUP BY 1, 2 HAVING sum(units) > 0) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY date DESC) <= 3",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max, count(*) AS n FROM events GROUP BY 1",
}

ORACLES |= {
    "festival_messages": f"""SELECT sku, state, CASE state WHEN 'adjusted' THEN 'The order is moved by a factor of ' || printf('%.2f', factor) || ': ' || days_adjusted || ' of the days ahead lie in a run-up.'
      WHEN 'advisory' THEN 'There is a festival in these days or soon after, and no figure for what it does to this product; the order stays.' ELSE 'No festival is near; the order stays.' END AS message FROM ({ORACLES['festival_plan']})""",
    "calendar_coverage": f"WITH {UPLOAD}, {FEASTS}, k AS (SELECT min(day) AS first_known, max(day) AS last_known FROM feasts), b AS (SELECT sku, max(date) + 60 AS e FROM brands GROUP BY 1) SELECT sku, first_known, last_known, CASE WHEN e > last_known THEN 'the festival calendar ends on ' || last_known || ' and cannot speak about ' || e END AS note FROM b, k",
    "sku_backtest": f"""WITH {UPLOAD}, b AS (SELECT sku, count(*) AS n_days, max(date) AS last FROM brands GROUP BY 1), c AS (SELECT *, CAST(greatest(0, least(5, floor((n_days - 28) / {A}))) AS INT) AS n FROM b),
      sku_folds AS (SELECT sku, fold, last - (n - fold) * {A} AS origin_date FROM (SELECT *, CAST(unnest(range(n)) AS INT) AS fold FROM c)),
      seen AS (SELECT sku, date, units_sold AS v FROM brands WHERE units_sold IS NOT NULL),
      train AS (SELECT s.sku, date, v, fold, origin_date, count(*) OVER p - row_number() OVER w AS back, v - lag(v, 7) OVER w AS residual, abs(v - lag(v) OVER w) AS change,
        CASE WHEN count(v) OVER f = {A} THEN sum(v) OVER f END AS total, min(CASE WHEN v > 0 THEN date END) OVER p AS sold FROM seen s JOIN sku_folds o ON o.sku = s.sku AND date <= origin_date
        WINDOW p AS (PARTITION BY s.sku, fold), w AS (PARTITION BY s.sku, fold ORDER BY date), f AS (PARTITION BY s.sku, fold ORDER BY date ROWS BETWEEN CURRENT ROW AND {A - 1} FOLLOWING)),
      fits AS (SELECT sku, fold, origin_date, median(residual) AS o, quantile_cont(total, {round(_ratio(_S), 4)}) AS ordered, avg(change) FILTER (date > sold) AS scale, list(v ORDER BY date) FILTER (back < 7) AS week FROM train GROUP BY 1, 2, 3),
      ahead AS (SELECT *, origin_date + h AS date, greatest(0.0::DOUBLE, week[(h - 1) % 7 + 1] + coalesce(o, 0)) AS path FROM fits, (SELECT CAST(unnest(range(1, {A + 1})) AS INT) AS h) WHERE len(week) = 7),
      judged AS (SELECT sku, fold, avg(abs(v - path)) AS mae, sum(v) - greatest(0.0::DOUBLE, max(ordered)) AS gap, max(scale) AS scale FROM ahead JOIN seen USING (sku, date) GROUP BY 1, 2)
      SELECT sku, fold, round(CASE WHEN scale > 1e-12 THEN mae / scale END, 6) AS mase, round(greatest({round(_ratio(_S), 4)}::DOUBLE * gap, {round(_ratio(_S), 4) - 1!r}::DOUBLE * gap), 6) AS pinball FROM judged""",
}
