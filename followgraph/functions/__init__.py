"""Column expressions: names, links, vectors."""
