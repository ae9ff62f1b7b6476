"""Structured Streaming twins of the window operators."""
