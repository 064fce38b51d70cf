"""Lattica: typed, provenance-carrying context graphs as Spark DataFrame programs."""

__version__ = "0.1.0"
