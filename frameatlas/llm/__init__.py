"""Operators for preparing training data from the archive."""
