"""Text operators as column expressions and DataFrame transforms."""
