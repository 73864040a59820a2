"""A PySpark engine for weighted market indexes, and for the preparation of training data."""
