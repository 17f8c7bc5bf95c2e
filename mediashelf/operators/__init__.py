"""Relational operators of the catalogue: DataFrame in, DataFrame out."""
