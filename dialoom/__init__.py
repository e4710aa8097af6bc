"""dialoom: a Spark-first engine for preparing dialogue training data."""

__version__ = "0.1.0"
