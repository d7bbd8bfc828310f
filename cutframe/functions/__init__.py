"""Scalar functions as column expressions, and Arrow kernels on pixels."""
