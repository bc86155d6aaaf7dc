"""Queries over driver tables."""
