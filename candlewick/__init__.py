"""Batch and streaming jobs over market tick data on Spark."""
