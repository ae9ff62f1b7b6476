"""Relational operators of the telemetry engine."""
