"""Structured Streaming forms of the tracker and of sessions."""
