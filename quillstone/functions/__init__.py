"""Column functions: text, names, amounts and dates."""
