"""Spark jobs which turn handbook-like documents into study and training data."""
