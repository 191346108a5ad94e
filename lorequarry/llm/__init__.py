"""Operators for training data at corpus scale."""
