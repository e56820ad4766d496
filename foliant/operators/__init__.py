"""Operators on tokens, pages and jobs."""
