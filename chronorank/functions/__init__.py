"""Column expressions: text, likelihood and identifiers."""
