"""Coordination detection and evidence analytics expressed as Spark jobs."""
