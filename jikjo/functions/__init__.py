"""Column functions and word lists."""
