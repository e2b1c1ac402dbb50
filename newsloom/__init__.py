"""Spark-native news ingest, search and credibility scoring.

The package is a set of functions from DataFrames to DataFrames.  Nothing keeps
a session of its own, and nothing here collects rows to the driver other than
values with a fixed bound (one page of ids, a fitted vocabulary, metric rows).
"""

__version__ = "0.1.0"
