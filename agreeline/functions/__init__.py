"""Scalar functions and text scores."""
