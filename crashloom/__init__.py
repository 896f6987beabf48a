"""Crash-report analytics as Spark DataFrame operators."""
