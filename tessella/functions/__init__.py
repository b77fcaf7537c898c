"""Column functions: pure expressions, no Python in the data path."""
