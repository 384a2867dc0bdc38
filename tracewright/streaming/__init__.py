"""Ingest of shards as they arrive. Not a feature of the batch reference: the same counts, kept up to date."""
