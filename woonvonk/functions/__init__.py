"""Column expressions: casts, text, numbers, dates, finance and bands."""
