"""Operators for large-scale training-data pipelines, one module each.

Every operator takes and returns DataFrames.  Modules hold the operator, and
``queries.py`` the thin queries that apply them to the standard tables.
"""
