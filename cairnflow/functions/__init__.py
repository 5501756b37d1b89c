"""Column functions: everything that works on one row."""
