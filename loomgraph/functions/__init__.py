"""Scalar expressions and fixed values."""
