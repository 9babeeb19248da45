"""Structured Streaming jobs over change events and transfer logs."""
