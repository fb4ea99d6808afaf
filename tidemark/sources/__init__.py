"""Readers of landed extracts and the mapping of their rows to a target."""
