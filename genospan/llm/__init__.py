"""Operators of a training-data pipeline: filtering, deduplication, search, packing, mixing.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names and returns a DataFrame; ``queries`` registers one query per operator.
"""
