"""Column functions: box geometry and vectors."""
