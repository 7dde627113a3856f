"""Operators for preparing training text at corpus scale.

Each module holds one operator with a general interface on DataFrames; `queries` holds the
thin registered queries.  Nothing outside this package imports it.
"""
