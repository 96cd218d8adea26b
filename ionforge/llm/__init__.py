"""Operators of a training-data pipeline: tokenizing, scoring, filtering, deduplication, search and mixing."""
