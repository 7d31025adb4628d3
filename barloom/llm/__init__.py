"""Operators for building language-model training data out of raw documents and pages."""
