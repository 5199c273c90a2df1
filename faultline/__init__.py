"""Incident telemetry and investigation evaluation as Spark DataFrame operators."""
