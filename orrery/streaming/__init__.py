"""Incremental ingestion with Structured Streaming."""

from orrery.streaming.incremental import upsert_stream, windowed_counts

__all__ = ["upsert_stream", "windowed_counts"]
