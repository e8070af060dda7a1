"""Operators for large-scale preparation of training data. Nothing outside this subpackage imports it."""
