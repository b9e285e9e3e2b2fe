"""Operators of a training-data pipeline: scoring, tokenising, archiving, deduplicating, packing."""
