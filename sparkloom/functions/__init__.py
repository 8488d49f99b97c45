"""Column functions: missing values, texts, coded fields, metrics and statistics."""
