"""Quoin: page-layout and web-corpus analytics expressed as Spark DataFrame plans."""
