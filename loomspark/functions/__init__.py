"""Column functions: Python-compatible text primitives, tokens and savings."""
