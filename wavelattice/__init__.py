"""Spark-native analytics over ordered signal, packet and frame data."""

__version__ = "0.1.0"
