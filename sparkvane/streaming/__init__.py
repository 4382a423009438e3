"""Structured Streaming: ingestion with acknowledgements, per-key gates and heartbeats."""
