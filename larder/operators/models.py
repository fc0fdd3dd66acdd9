"""Learned models: exponential smoothing of each series, features of trees, and a forest with the quantiles of its leaves."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import schema as S
from larder.operators import forecasting as fc

SERIES = fc.SERIES
# Normal quantiles of the levels, and the smoothing constants that are tried.
Z = {0.1: -1.2815515655446004, 0.25: -0.6744897501960817, 0.5: 0.0, 0.75: 0.6744897501960817, 0.9: 1.2815515655446004, 0.95: 1.6448536269514722, 0.99: 2.3263478740408408}
GRID = [(a, g) for a in (0.02, 0.05, 0.1, 0.2, 0.4) for g in (0.01, 0.05, 0.15)]


def smooth(y: np.ndarray, origins: Sequence[int], horizon: int, season: int = S.SEASON) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Additive level and season without trend, of many series of one length at once (rows of ``y``).

    For each origin (days of training) the paths, error deviations and level constants. All constants run through the series once; at
    each origin a series takes those with the least squared error up to it.
    """
    y = np.atleast_2d(np.asarray(y, float))
    alpha, gamma = (np.array(x) for x in zip(*GRID, strict=True))
    first = y[:, : 2 * season] if y.shape[1] >= 2 * season else y
    mean = first.mean(axis=1) if first.shape[1] else np.zeros(len(y))
    level = np.repeat(mean[:, None], len(GRID), axis=1)
    seasonal = np.stack([np.repeat((first[:, i::season].mean(axis=1) - mean if first[:, i::season].shape[1] else np.zeros(len(y)))[:, None], len(GRID), axis=1) for i in range(season)])
    sse, out, at, each = np.zeros_like(level), {}, set(origins), np.arange(len(y))
    for t in range(y.shape[1] + 1):
        if t in at:
            k = np.argmin(sse, axis=1)
            path = np.stack([level[each, k] + seasonal[(t + h) % season][each, k] for h in range(horizon)], axis=1)
            out[t] = (path, np.sqrt(sse[each, k] / max(t, 1)), alpha[k])
        if t == y.shape[1]:
            break
        error = y[:, t, None] - level - seasonal[t % season]
        sse += error * error
        level = level + alpha * error
        seasonal[t % season] += gamma * error
    return [out[t] for t in origins]


# Forms of smoothing (trend: none, additive, damped; season or not), the constants that are tried, and the damping.
FORMS = tuple((trend, season) for trend in ("none", "additive", "damped") for season in (False, True))
ALPHA, BETA, GAMMA, DAMPING = (0.02, 0.05, 0.1, 0.2, 0.4), (0.002, 0.01, 0.05), (0.01, 0.05, 0.15), 0.9


def form_grid() -> tuple[np.ndarray, ...]:
    """Every form with every choice of its constants: form, level, trend and season constant, damping, and number of fitted values."""
    rows = []
    for k, (trend, season) in enumerate(FORMS):
        for a in ALPHA:
            for b in BETA if trend != "none" else (0.0,):
                for g in GAMMA if season else (0.0,):
                    # constants, first states (a season sums to zero) and the deviation
                    n = 1 + 1 + 1 + 2 * (trend != "none") + (trend == "damped") + (1 + S.SEASON - 1) * season
                    rows.append((k, a, b, g, {"none": 0.0, "additive": 1.0, "damped": DAMPING}[trend], n))
    return tuple(np.array(c) for c in zip(*rows, strict=True))


def selected(y: np.ndarray, origins: Sequence[int], horizon: int, season: int = S.SEASON) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Smoothing of many series of one length at once, each at each origin in the form and with the constants of the least AICc up to it.

    All forms have additive errors. All choices run through the series once. For each origin (days of training): the paths, the
    deviations by day ahead, the forms (places in ``FORMS``) and their AICc. The AICc is that of Gaussian errors, but for a constant.
    """
    y = np.atleast_2d(np.asarray(y, float))
    form, alpha, beta, gamma, phi, n_values = form_grid()
    seasonal = np.array([FORMS[k][1] for k in form])
    first = y[:, : 2 * season] if y.shape[1] >= 2 * season else y
    mean = first.mean(axis=1) if first.shape[1] else np.zeros(len(y))
    many = len(form)
    level, slope = np.repeat(mean[:, None], many, axis=1), np.zeros((len(y), many))
    # the mean of each weekday of the first weeks, less the mean of those
    start = np.stack([first[:, i::season].mean(axis=1) if first[:, i::season].shape[1] else mean for i in range(season)])
    start = start - start.mean(axis=0)
    states = np.where(seasonal, np.repeat(start[:, :, None], many, axis=2), 0.0)
    sse, out, at, each = np.zeros_like(level), {}, set(origins), np.arange(len(y))
    for t in range(y.shape[1] + 1):
        if t in at:
            with np.errstate(divide="ignore"):
                fit = t * np.log(np.maximum(sse, 1e-12) / max(t, 1)) + 2 * n_values + np.where(t - n_values - 1 > 0, 2 * n_values * (n_values + 1) / np.maximum(t - n_values - 1, 1), np.inf)
            k = np.argmin(np.where(np.isfinite(fit), fit, np.finfo(float).max), axis=1)  # the first form where none can be told
            step = np.arange(1, horizon + 1)
            damp = np.cumsum(phi[k][:, None] ** step, axis=1)  # what a slope adds by each day ahead
            path = level[each, k][:, None] + slope[each, k][:, None] * damp + np.stack([states[(t + h) % season][each, k] for h in range(horizon)], axis=1)
            c = alpha[k][:, None] + beta[k][:, None] * damp + gamma[k][:, None] * (step % season == 0)
            spread = np.sqrt(1 + np.concatenate((np.zeros((len(y), 1)), np.cumsum(c * c, axis=1)[:, :-1]), axis=1))
            out[t] = (path, np.sqrt(sse[each, k] / max(t, 1))[:, None] * spread, form[k], fit[each, k])
        if t == y.shape[1]:
            break
        now = states[t % season]
        ahead = level + phi * slope
        error = y[:, t, None] - ahead - now
        sse += error * error
        level, slope = ahead + alpha * error, phi * slope + beta * error
        states[t % season] = now + gamma * error
    return [out[t] for t in origins]


#: Series that are smoothed together, about.
TOGETHER = 256


def _together(fact: DataFrame, folds: list[tuple[int, date]], rows_of, ddl: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """What ``rows_of`` (series, values, ends) makes of series that go together by hash, some hundreds at a time, those of one span in one pass."""

    keys = list(keys)

    def run(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values([*keys, "date"])
        days["day"] = pd.to_datetime(days["date"])
        out = []
        spans = days.groupby(keys)["day"].agg(["min", "max", "count"])
        for (start, _, n), same in spans.groupby(["min", "max", "count"]):
            own = days.set_index(keys).loc[same.index]
            y = own["units"].to_numpy(float).reshape(len(same), n)
            when = own["day"].to_numpy().reshape(len(same), n)[0]
            ends = [int(np.searchsorted(when, np.datetime64(o), "right")) for _, o in folds]
            out += rows_of(same.index, y, ends)
        return pd.concat(out)

    groups = -(-fact.select(*keys).distinct().count() // TOGETHER) or 1
    rows = fact.select("date", *keys, "units", F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("together"))
    return rows.groupBy("together").applyInPandas(run, ddl)




def _quantile_ddl(keys: Sequence[str]) -> str:
    return f"fold int, origin_date date, target_date date, horizon int, {', '.join(f'{k} string' for k in keys)}, quantile double, yhat double"


def _quantile_rows(index, fold: int, origin: date, path: np.ndarray, wide: np.ndarray, levels: Sequence[float]) -> pd.DataFrame:
    """A row for each series, day ahead and level, from paths and deviations."""
    z = np.array([Z[q] for q in levels])
    value = np.maximum(0.0, path[:, :, None] + z[None, None, :] * wide[:, :, None])
    i, h, q = (x.ravel() for x in np.indices(value.shape))
    return pd.DataFrame({
        "fold": fold, "origin_date": origin, "target_date": (pd.Timestamp(origin) + pd.to_timedelta(h + 1, "D")).date, "horizon": h + 1,
        **{k: index.get_level_values(k).to_numpy()[i] for k in index.names}, "quantile": np.array(levels)[q], "yhat": value.ravel()})


def ets(fact: DataFrame, folds: list[tuple[int, date]], levels: Sequence[float] = S.LEVELS, horizon: int = S.HORIZON, keys: Sequence[str] = SERIES) -> DataFrame:
    """Quantile rows of every series (or node, or what else ``keys`` tell apart) and fold, in one form of smoothing: level and season."""

    def rows_of(index, y: np.ndarray, ends: list[int]) -> list[pd.DataFrame]:
        step = np.arange(horizon)
        return [_quantile_rows(index, fold, origin, path, sigma[:, None] * np.sqrt(1 + step[None, :] * (alpha * alpha)[:, None]), levels)
                for (fold, origin), (path, sigma, alpha) in zip(folds, smooth(y, ends, horizon), strict=True)]

    return _together(fact, folds, rows_of, _quantile_ddl(keys), keys).withColumn("model_name", F.lit("ets"))


def ets_selected(fact: DataFrame, folds: list[tuple[int, date]], levels: Sequence[float] = S.LEVELS, horizon: int = S.HORIZON) -> DataFrame:
    """Quantile rows of every series and fold, each in the form of the least AICc."""

    def rows_of(index, y: np.ndarray, ends: list[int]) -> list[pd.DataFrame]:
        return [_quantile_rows(index, fold, origin, path, wide, levels) for (fold, origin), (path, wide, _, _) in zip(folds, selected(y, ends, horizon), strict=True)]

    return _together(fact, folds, rows_of, _quantile_ddl(SERIES)).withColumn("model_name", F.lit("ets_selected"))


def chosen_forms(fact: DataFrame, folds: list[tuple[int, date]]) -> DataFrame:
    """The form of smoothing of each series and fold: fold, item_id, store_id, trend, season, aicc."""

    def rows_of(index, y: np.ndarray, ends: list[int]) -> list[pd.DataFrame]:
        return [pd.DataFrame({"fold": fold, "item_id": index.get_level_values(0), "store_id": index.get_level_values(1), "trend": [FORMS[k][0] for k in form], "season": [FORMS[k][1] for k in form], "aicc": aicc})
                for (fold, _), (_, _, form, aicc) in zip(folds, selected(y, ends, 1), strict=True)]

    return _together(fact, folds, rows_of, "fold int, item_id string, store_id string, trend string, season boolean, aicc double")


FEATURES = [*(f"units_lag_{k}" for k in S.LAGS), *(f"units_roll_{f}_{n}" for n in S.WINDOWS for f in ("mean", "std", "max")), "zero_share_90", "days_since_last_sale", "price_rel_28", "days_since_event", "days_to_event", "month", "wday", "snap"]


#: What boosted trees learn from: the same, and what an item, a store and a department sold on average up to the first origin.
BOOSTED_FEATURES = [*FEATURES, "item_mean", "store_mean", "dept_mean"]


def with_means(features: DataFrame, until: date) -> DataFrame:
    """Features with the mean units of each row's item, store and department up to a day; null for those that are new after it."""
    past = features.where(F.col("date") <= F.lit(until))
    for name, key in (("item_mean", "item_id"), ("store_mean", "store_id"), ("dept_mean", "dept_id")):
        features = features.join(past.groupBy(F.col(key).alias("k")).agg(F.avg("units").alias(name)), F.col(key) == F.col("k"), "left").drop("k")
    return features


#: Series and departments go into the trees by hash, in so many bins: no list of them is gathered on the driver.
HASHED = 32


def assembled(features: DataFrame) -> DataFrame:
    """A vector of the features, series by hash; -1 stands for a missing one, which a tree can split off."""
    from pyspark.ml.feature import VectorAssembler

    names = ["item_id", "store_id", "dept_id"]
    filled = features.withColumns({f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in FEATURES} | {f"f_{c}": F.pmod(F.xxhash64(c), F.lit(HASHED)).cast("double") for c in names})
    return VectorAssembler(inputCols=[f"f_{c}" for c in (*FEATURES, *names)], outputCol="x").transform(filled)


def forest(rows: DataFrame, origin: date, trees: int = 8, levels: Sequence[float] = S.LEVELS, horizon: int = S.HORIZON, days: int | None = None) -> tuple[DataFrame, object]:
    """A forest fitted on all assembled rows up to the origin, and its quantile rows after it.

    A leaf's quantiles are those of the units of the training rows in it, which is what the pinball loss asks of a constant; a row's are
    the means over the trees. (forecast rows, model)
    """
    from pyspark.ml.regression import RandomForestRegressor

    past = _past(rows, origin, days).select("x", F.col("units").cast("double").alias("units"))
    model = RandomForestRegressor(featuresCol="x", labelCol="units", predictionCol="point", leafCol="leaf", numTrees=trees, maxDepth=6, maxBins=64, minInstancesPerNode=20, subsamplingRate=0.7, seed=S.SEED).fit(past)
    from pyspark.ml.functions import vector_to_array

    in_leaf = lambda df: model.transform(df).withColumn("leaf", vector_to_array("leaf"))
    leaves = in_leaf(past).select("units", F.posexplode("leaf").alias("tree", "node")).groupBy("tree", "node").agg(F.percentile("units", F.array(*[F.lit(q) for q in levels])).alias("values"))
    ahead = rows.where((F.col("date") > F.lit(origin)) & (F.col("date") <= F.date_add(F.lit(origin), horizon)))
    ahead = in_leaf(ahead.select("date", *SERIES, "x")).select("date", *SERIES, F.posexplode("leaf").alias("tree", "node"))
    ahead = ahead.join(F.broadcast(leaves), ["tree", "node"])  # trees times leaves, at most 8 times 64 rows
    grid = F.posexplode(F.col("values")).alias("n", "value")
    mean = ahead.select("date", *SERIES, grid).groupBy("date", *SERIES, "n").agg(F.avg("value").alias("yhat"))
    level = F.element_at(F.array(*[F.lit(q) for q in levels]), F.col("n") + 1)
    out = mean.select(F.lit("forest").alias("model_name"), F.lit(origin).alias("origin_date"), F.col("date").alias("target_date"), F.datediff("date", F.lit(origin)).alias("horizon"), *SERIES, level.alias("quantile"), F.greatest(F.lit(0.0), "yhat").alias("yhat"))
    return out, model


def _past(rows: DataFrame, origin: date, days: int | None) -> DataFrame:
    known = rows.where(F.col("date") <= F.lit(origin))
    return known if days is None else known.where(F.col("date") >= F.date_sub(F.lit(origin), days))


def isolated(fit, columns: Sequence[str]):
    """A grouped function whose failure on one product gives a row that says so, instead of ending the job: sku, status, error and its columns."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fit(key, rows)
            out = out.assign(sku=key[0], status="done", error=None)
        except Exception as e:
            out = pd.DataFrame([{"sku": key[0], "status": "failed", "error": f"{type(e).__name__}: {e}"}])
        return out.reindex(columns=["sku", "status", "error", *columns])

    return run
