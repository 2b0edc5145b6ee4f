"""Queries registered in ``__spark_entry__.py`` with their SQL oracles."""
