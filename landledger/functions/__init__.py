"""Column expressions: text, numbers, dates, geography, URLs, formats."""
