"""Afterbell: streaming."""
