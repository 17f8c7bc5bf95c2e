"""Scalar functions as native Column expressions (no Python UDFs)."""
