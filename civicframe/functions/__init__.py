"""Column-to-Column functions: null rules, text, dates, numbers."""
