"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames; the thin ``opN_*`` queries live in ``queries.py``.
"""
