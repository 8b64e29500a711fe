"""Quoin streaming."""
