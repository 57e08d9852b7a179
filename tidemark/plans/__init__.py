"""Composed transforms: what runs end to end."""
