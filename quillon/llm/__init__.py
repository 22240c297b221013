"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries in :mod:`quillon.llm.queries` derive
their digest columns from the operators' own results.
"""
