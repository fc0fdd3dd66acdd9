"""Table schemas and fixed settings of the demand model."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**fields: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in fields.items()))


def fact_sales() -> T.StructType:
    return _table(date="date", item_id="string", store_id="string", dept_id="string", cat_id="string", state_id="string", units="int", price="double", snap="int", event="string")


def forecast() -> T.StructType:
    return _table(model_name="string", fold="int", origin_date="date", target_date="date", horizon="int", level="string", item_id="string", store_id="string", dept_id="string", quantile="double", yhat="double", reconciled="boolean")


def uploads() -> T.StructType:
    return _table(sku="string", date="string", units_sold="string", unit_price="string")


def demand_rules() -> T.StructType:
    return _table(festival_key="string", festival="string", direction="string", category="string", items="string", suggested_multiplier="double", notes="string")


# Horizon and number of folds of the backtest, stratification window, season, quantile levels.
HORIZON, N_FOLDS, STRATIFY_DAYS, SEASON = 28, 5, 90, 7
BACKTEST_DAYS = HORIZON * N_FOLDS
LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
STRATA = ("dense", "mid", "sparse")
# Lags and windows of the feature panel.
LAGS, WINDOWS = (7, 14, 28, 365), (7, 28, 90)
# Public holidays with a date of their own in every year.
EVENTS = {"01-01": "NewYear", "02-14": "ValentinesDay", "07-04": "IndependenceDay", "10-31": "Halloween", "12-25": "Christmas"}
SEED = 20260807
