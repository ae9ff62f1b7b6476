"""Scans, validation and sinks."""
