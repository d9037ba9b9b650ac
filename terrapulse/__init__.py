"""Territorial and pixel-time-series analytics as Spark DataFrame jobs."""
