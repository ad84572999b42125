"""Column expressions, fixed vocabularies and bounded-memory statistics."""
