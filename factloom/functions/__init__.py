"""Column functions: text, numbers, dates, labels and rules."""
