"""Operators that prepare training data, each over a DataFrame of documents."""
