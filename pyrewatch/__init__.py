"""Incident evidence analytics as PySpark jobs, keyed by incident."""
