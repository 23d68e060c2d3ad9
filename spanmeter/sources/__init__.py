"""Readers, writers and the fixed schemas of the trace tables."""
