"""Column functions: digit repair, text clean-up, geometry, similarity."""
