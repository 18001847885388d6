"""Structured Streaming: incremental indexing, keyed state, task progress, windowed counts."""
