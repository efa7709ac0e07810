"""Operators for preparing training data: media, archives, near copies, mixing, shards, filters, packing, formatting."""
