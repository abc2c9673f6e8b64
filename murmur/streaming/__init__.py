"""Structured Streaming forms of the detection, content and collection jobs."""
