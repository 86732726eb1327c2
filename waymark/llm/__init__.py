"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries.py`` holds the registered queries and their SQL.
"""
