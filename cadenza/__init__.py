"""Cadenza: analytics over ordered, gap-aware sample streams, on Spark."""

__version__ = "0.1.0"
