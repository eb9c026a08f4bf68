"""Column functions over text, names and JSON."""
