"""Operators for building training data from the documents of a collection."""
