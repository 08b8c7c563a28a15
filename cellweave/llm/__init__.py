"""Operators for preparing training data: mixing, near-duplicates, search, tokens, archives, classifiers."""
