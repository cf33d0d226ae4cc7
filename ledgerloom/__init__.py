"""Spark-native building blocks for account-transaction tables."""

from ledgerloom.session import get_spark

__all__ = ["get_spark"]
