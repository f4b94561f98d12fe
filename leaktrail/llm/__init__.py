"""Operators of a training-data pipeline: quality, tokens, toxicity, duplicates, shards and mixtures."""
