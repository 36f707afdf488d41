"""Column functions: text normalization, tokens, distances, predicates, hashes."""
