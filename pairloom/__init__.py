"""Spark toolkit for text-vector pair data."""
