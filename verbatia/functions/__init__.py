"""Scalar column functions: normalisation levels and small text helpers."""
