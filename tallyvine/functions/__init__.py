"""Column expressions: texts, attributes of cards, vectors."""
