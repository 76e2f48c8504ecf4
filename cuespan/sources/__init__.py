"""Corpus readers and table sinks."""
