"""Operators on snapshots, commits and table data."""
