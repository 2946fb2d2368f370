"""sources of Tidemark."""
