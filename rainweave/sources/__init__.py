"""Readers, table views over the given data, and writers."""
