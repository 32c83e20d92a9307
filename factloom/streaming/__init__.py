"""Structured Streaming versions of the scan, drift check, delta and activity jobs."""

from factloom.streaming.jobs import (  # noqa: F401
    debounce_changes,
    heartbeat_drift,
    stream_activity,
    stream_corpus,
    stream_delta,
    stream_facts,
)
