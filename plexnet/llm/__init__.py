"""Operators of a large-scale training-data pipeline on Spark DataFrames.

Nothing outside this subpackage imports it; ``catalog.py`` registers its
queries (one per operator) and their DuckDB SQL.
"""
