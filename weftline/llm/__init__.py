"""Operators for training data: terms, co-occurrence, vectors, groups, packing, mixing and text forms."""
