"""Operators for training data: top items per group, repeated events, encoding, leaked evaluation texts, text quality."""
