"""Operators of a training-data pipeline: archives, deduplication, models, mixing and packing."""
