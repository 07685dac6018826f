"""Spark-first analytics over random spanning forests, plus training-data operators."""
