"""Clonal families of B-cell-receptor sequences, on Spark."""

__version__ = "0.2.0"
