"""Operators on snapshots and on result tables."""
