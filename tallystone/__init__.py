"""Auditable transaction analytics as PySpark DataFrame operators."""
