"""Operators of a training-data pipeline: scoring, extraction, packing, dedup and output."""
