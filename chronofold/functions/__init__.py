"""Calculators, their settings and their names."""
