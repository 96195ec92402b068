"""Keyed entity tables and their changes as PySpark DataFrame operators."""

__version__ = "0.1.0"
