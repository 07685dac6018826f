"""Operators on graphs, forests and partitions."""
