"""Column expressions: names, geometry, fixed-point text."""
