"""Operators for preparing training data: archives, shards, packing, search, near-duplicates, language,
repeated passages, token totals, toxicity and benchmark leaks, with their queries."""
