"""Column functions: text patterns, answers, question kinds, numbering and JSON recovery."""
