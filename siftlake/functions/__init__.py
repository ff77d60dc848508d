"""Column functions: text, JSON recovery, labels and paths."""
