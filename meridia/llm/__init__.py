"""Operators for large text corpora: output, mixing, deduplication, filtering and scoring.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames;
``queries`` holds the registered queries and their SQL.
"""
