"""DataFrame -> DataFrame operators over timed tables."""
