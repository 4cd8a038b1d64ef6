"""Structured Streaming operators: debounce, sweep and incremental index."""
