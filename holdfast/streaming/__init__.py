"""Streaming entry points (see tradebook_stream)."""
