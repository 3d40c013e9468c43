"""Scalar functions and small dense kernels."""
