"""Observation-based operators over unbounded input."""
