"""Tidemark: market-research analytics expressed as Spark plans."""
