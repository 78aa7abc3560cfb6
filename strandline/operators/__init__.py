"""Operators of strandline."""
