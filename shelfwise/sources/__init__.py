"""Readers, writers and the stock tables derived from the order tables."""
