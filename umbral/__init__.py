"""Household poverty analytics as PySpark DataFrame, SQL and Spark ML plans."""
