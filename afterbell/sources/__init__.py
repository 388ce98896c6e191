"""Afterbell: sources."""
