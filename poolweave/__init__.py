"""Cohort, feature and query-selection operators as Spark DataFrame plans."""

__version__ = "0.1.0"
