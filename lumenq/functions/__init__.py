"""Scalar, vector and aggregate functions, and embedders."""
