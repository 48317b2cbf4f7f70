"""Operators for building language-model training data at cluster scale.

Nothing outside this package imports it.  Each module holds one operator with
its own general interface; ``queries`` holds the registered queries and SQL.
"""
