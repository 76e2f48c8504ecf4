"""Timed-media analytics as Spark jobs: cues, cuts, segments, candidates, timelines."""
