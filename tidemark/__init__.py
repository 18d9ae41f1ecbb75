"""Benchmarking of short time-series forecasters, and training-data operators, on Spark."""
