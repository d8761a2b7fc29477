"""Readers to typed DataFrames and sinks, all through Spark's own formats, so any path that Spark can open works."""
