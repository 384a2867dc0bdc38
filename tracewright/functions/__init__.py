"""Scalar expressions: metrics on arrays, text rules, ranks."""
