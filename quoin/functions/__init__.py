"""Quoin functions."""
