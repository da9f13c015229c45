"""Readers, writers, explicit schemas and the views over the driver tables."""
