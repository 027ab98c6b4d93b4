"""Operators of a training-data pipeline: filters, scores, duplicates, mixing and token output."""
