"""Operators for training data: text consistency, privacy, duplicates, splits, leaks, mixtures, sentences."""
