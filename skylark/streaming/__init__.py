"""Stateful behaviour as Structured Streaming."""
