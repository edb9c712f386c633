"""Operators over events, artifacts and shards."""
