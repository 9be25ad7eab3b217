"""Incremental forms of the batch sinks."""
