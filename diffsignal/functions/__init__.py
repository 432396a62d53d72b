"""Column functions: pure expressions over strings, paths, numbers, vectors and JSON."""
