"""Predictive-maintenance analytics as PySpark DataFrame, SQL and streaming operators."""
