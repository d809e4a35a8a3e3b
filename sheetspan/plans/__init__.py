"""Registered queries over derived tables."""
