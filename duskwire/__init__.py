"""Sensitive-content analytics over text collections, as PySpark DataFrame plans."""

__version__ = "0.1.0"
