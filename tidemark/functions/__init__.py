"""Column functions: text, numeric and formatting expressions."""
