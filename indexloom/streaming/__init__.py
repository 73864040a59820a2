"""Structured Streaming: stateful gating and sinks."""
