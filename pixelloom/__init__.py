"""Similarity, deduplication and triage analytics for image and document collections on Spark."""
