"""Operators of a training-data pipeline: tokens, media, packing, archives, dedup, search, shards."""
