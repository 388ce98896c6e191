"""Afterbell: functions."""
