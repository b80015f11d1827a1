"""Composite jobs, and the catalogue of queries over the sample tables."""
