"""Spark jobs for motion-capture tables."""
