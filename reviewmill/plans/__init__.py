"""Whole jobs composed from the operators: import, scoring, training, search."""
