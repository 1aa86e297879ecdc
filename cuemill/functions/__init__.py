"""Column functions: text, geometry, model messages."""
