"""Operators for training-data pipelines over text tables.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; `queries` holds the thin registered queries.
"""
