"""Registered queries (Spark side) and their SQL oracles."""
