"""Fixtures over the driver tables and the query registry."""
