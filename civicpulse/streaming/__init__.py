"""Structured Streaming: sources, decoding, first arrival, sinks."""
