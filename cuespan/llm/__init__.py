"""Operators over text corpora for training data; nothing outside this package imports it."""
