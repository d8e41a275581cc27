"""Market-style time-series analytics as DataFrame -> DataFrame functions on Spark."""

from barspark.session import get_spark

__all__ = ["get_spark"]
