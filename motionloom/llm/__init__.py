"""Operators of a training-data pipeline: deduplication, filtering, counting, scoring and mixing of text."""
