"""Operators of a training-data pipeline: ten operators and the queries that apply them."""
