"""Operators for training-data pipelines: defects, repetition, duplicates, leaks, packing, toxicity."""
