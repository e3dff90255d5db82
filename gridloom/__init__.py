"""gridloom: a Spark-native PromQL engine and time-series data-processing library."""

__version__ = "0.1.0"
