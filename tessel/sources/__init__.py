"""Readers and writers with declared schemas."""
