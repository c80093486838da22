"""Column functions: text to typed values, labels and names. All native expressions but for Unicode folding."""
