"""Column functions: text, scoring, dates and numbers."""
