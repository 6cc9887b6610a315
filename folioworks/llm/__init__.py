"""Operators for language-model training data, each over whole Spark tables."""
