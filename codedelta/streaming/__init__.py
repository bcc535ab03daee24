"""Structured Streaming jobs (micro-batch analysis, dedup, rate limit, status)."""
