"""Structured Streaming jobs over the order event stream."""
