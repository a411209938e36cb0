"""Structured Streaming: event intake (T1) and per-batch review."""
