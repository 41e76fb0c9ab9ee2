"""Structured Streaming jobs for link discovery, retry state and rate audits."""
