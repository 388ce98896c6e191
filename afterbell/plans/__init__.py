"""Afterbell: plans."""
