"""Structured Streaming forms: file intake, status upsert, progress, gap-limited sequences."""
