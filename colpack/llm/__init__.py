"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the
modules ``queries`` and ``sql`` hold the registered queries and their oracle SQL.
"""
