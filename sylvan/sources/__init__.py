"""Graphs and signals from tables, files and generators."""
