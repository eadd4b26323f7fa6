"""Operators for training-data corpora. Nothing outside this subpackage imports it."""
