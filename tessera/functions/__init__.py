"""Column functions: ownership of indices, generated values."""
