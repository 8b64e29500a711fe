"""Quoin plans."""
