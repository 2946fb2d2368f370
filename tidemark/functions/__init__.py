"""functions of Tidemark."""
