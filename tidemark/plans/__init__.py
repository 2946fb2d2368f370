"""plans of Tidemark."""
