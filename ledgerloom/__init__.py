"""Spark-first engine for combining, dividing and reusing business tables."""
