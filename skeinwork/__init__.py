"""Telemetry analytics as DataFrame, Spark SQL and Structured Streaming operators."""
