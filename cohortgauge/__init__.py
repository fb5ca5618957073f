"""Cohort building and subgroup error auditing on Spark DataFrames."""

__version__ = "0.1.0"
