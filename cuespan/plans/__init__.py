"""Registered queries: domain tables derived from the given tables, one operator per query."""
