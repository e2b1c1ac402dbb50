"""Operators of a training-data pipeline over documents and pages.

Nothing else in the library imports this package.  Every operator is a function from
DataFrames to a DataFrame; the registered queries are in :mod:`.queries`.
"""
