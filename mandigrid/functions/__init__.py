"""Column expressions: missing values, text, similarity, dates and keys."""
