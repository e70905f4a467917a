"""Edges as they come."""
