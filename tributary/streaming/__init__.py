"""Structured Streaming over artifact folders."""
