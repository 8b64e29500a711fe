"""Quoin operators."""
