"""Granary: corpus analytics on Spark."""
