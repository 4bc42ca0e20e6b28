"""A PySpark engine for Japanese text and for training-data corpora."""
