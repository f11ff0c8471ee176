"""Column functions: selectors, encryption, values."""
