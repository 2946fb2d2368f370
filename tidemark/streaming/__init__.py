"""streaming of Tidemark."""
