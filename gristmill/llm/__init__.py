"""Operators for preparing training data: ten methods over whole corpora."""
