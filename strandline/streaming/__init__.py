"""Streaming of strandline."""
