"""Whole pipelines and their reports."""
