"""Operators on interval tables."""
