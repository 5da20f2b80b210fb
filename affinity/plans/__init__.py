"""Whole pipelines, from a log to results."""
