"""Operators of a training-data pipeline: dedup, formatting, counting, filtering, sharding."""
