"""Scalar expressions, all built from Spark's own functions."""
