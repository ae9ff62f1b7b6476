"""Spark-native reasoning over event telemetry with gaps, and corpus operators in ``gapwright.llm``."""
