"""Operators for training-data pipelines over code, documents and votes."""
