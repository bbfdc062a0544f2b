"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it.  Each module holds one operator and
the thin query that applies it to a whole table.
"""
