"""Trace, thread-dump, run-log and source-corpus analytics as plain Spark DataFrame plans."""
