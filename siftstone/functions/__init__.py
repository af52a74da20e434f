"""Column functions: text, hashing, signatures, bands."""
