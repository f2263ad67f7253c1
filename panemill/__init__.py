"""Windowed aggregation over event streams, and corpus operators, on Spark."""
