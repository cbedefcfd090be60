"""Probabilistic forecasting on Spark tables: DataFrame in, DataFrame out."""

LEVELS = (0.025, 0.25, 0.5, 0.75, 0.975)
