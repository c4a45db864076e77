"""Readers and writers. Readers declare schemas, prune columns and take the year from the path."""
