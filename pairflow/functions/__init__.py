"""Column functions: scalar expressions, curve models, text extraction, hashing."""
