"""Demand analytics on Spark: panels, features, forecasts, scoring, reconciliation and order policies as DataFrame plans."""
