"""Operators of a training-data pipeline: deduplication, filtering, language
identification, scoring, mixing, search and tokenisation on DataFrames.

Nothing else in the library imports this subpackage.
"""
