"""Scalar functions as Column expressions, and parsers of model output."""
