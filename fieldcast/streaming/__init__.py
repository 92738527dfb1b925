"""Structured Streaming jobs over the feedback log."""
