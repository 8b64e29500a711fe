"""Quoin sources."""
