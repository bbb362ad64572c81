"""Column functions and their SQL registration."""
