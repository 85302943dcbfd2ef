"""Readers, writers, parsers of stored records, and the views over the driver's tables."""
