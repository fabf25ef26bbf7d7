"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Each module holds one operator with a general
interface over DataFrames; ``queries`` binds them to the shared tables.
"""
