"""Framing of unbounded streams with Structured Streaming."""
