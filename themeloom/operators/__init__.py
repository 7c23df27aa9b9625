"""Relational, text and vector operators."""
