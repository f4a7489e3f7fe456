"""Operators for building training data: grouping, splitting, overlap, sampling, encoding."""
