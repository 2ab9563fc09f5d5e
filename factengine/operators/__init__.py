"""Operators over the model's tables."""
