"""operators of Tidemark."""
