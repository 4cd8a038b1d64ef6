"""Ingest plans: decoding, validation and execution."""
