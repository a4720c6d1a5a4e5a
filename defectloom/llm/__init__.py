"""Operators of a training-data pipeline: tokens, filters, near copies, shards and mixtures."""
