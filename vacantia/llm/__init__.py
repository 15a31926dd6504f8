"""Corpus operators for training data: packing, archives, sharding, scans, counts and deduplication."""
