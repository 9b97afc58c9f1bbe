"""Incremental table sync and row transforms as Spark DataFrame operators."""

__version__ = "0.1.0"
