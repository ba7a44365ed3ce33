"""Operators over text corpora and vectors for the making of training data."""
