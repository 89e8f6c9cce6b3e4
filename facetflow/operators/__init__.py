"""Operators on detected graphs."""
