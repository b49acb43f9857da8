"""A PySpark engine that turns corpora into compact, token-efficient packages."""
