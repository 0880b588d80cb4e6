"""Longitudinal results analytics as Spark DataFrame jobs."""
