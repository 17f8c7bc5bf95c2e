"""Operators for preparing training data: search, filtering, deduplication, mixing, tokens.

Each module holds one operator with its own interface and, at its end, the thin registered
query over the driver's tables. Nothing outside this subpackage imports it except
``__spark_entry__.py``, which adds its queries when it is present.
"""
