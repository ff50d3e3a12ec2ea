"""loomline: a Spark-first analytics engine for label-identified time series."""

__version__ = "0.1.0"
