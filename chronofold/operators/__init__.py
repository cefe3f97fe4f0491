"""Relational and record-level operators."""
