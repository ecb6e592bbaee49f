"""Column -> Column functions: text, scores, display values, vectors."""
