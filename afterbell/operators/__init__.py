"""Afterbell: operators."""
