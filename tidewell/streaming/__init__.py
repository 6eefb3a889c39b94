"""Continuous imports with Structured Streaming."""
