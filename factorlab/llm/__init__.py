"""Corpus operators for training data: duplicates, personal data, language, packing and search."""
