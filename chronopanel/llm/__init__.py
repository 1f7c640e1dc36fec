"""Operators for building training corpora: archives, privacy, dedup, packing, mixing, quality.

Every operator takes and returns DataFrames and keeps a general interface;
``queries.py`` holds the thin registered queries that derive digest columns.
"""
