"""Datasets and reports. Each is a function from tables to a DataFrame without any action."""
