"""Readers, stores and decoders."""
