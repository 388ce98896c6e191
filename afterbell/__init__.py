"""Afterbell: event evidence and reaction analytics as PySpark DataFrame operators."""
