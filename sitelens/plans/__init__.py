"""Composed plans: derived inputs, report tables and the query registry."""
