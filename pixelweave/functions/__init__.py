"""Column functions: complex numbers, time bases, dates and test statistics."""
