"""Operators on arbitrary DataFrames: quality checks, joins, cascades, publishing."""
