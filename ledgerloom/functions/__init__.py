"""Column functions: text, dates and money."""
