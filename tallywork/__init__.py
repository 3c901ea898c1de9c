"""Benchmark-measurement analytics as Spark plans."""
