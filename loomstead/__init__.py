"""Spark-first analytics over document metadata tables."""
