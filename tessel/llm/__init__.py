"""Operators on source and document text for training-data pipelines. Nothing outside this package imports it."""
