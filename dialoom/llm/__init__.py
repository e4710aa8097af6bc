"""Corpus operators for large language-model training data."""
