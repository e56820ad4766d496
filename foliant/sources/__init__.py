"""Readers and the tables they make."""
