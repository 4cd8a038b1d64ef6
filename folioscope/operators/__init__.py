"""Relational operators over pages, tags, edges, logs and change feeds."""
