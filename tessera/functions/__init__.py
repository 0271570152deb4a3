"""Column expressions: identifiers and spans."""
