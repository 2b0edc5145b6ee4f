"""Reusable DataFrame operators; none of them knows a concrete table."""
