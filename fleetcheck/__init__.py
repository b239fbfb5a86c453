"""Driver-facing checks: inputs derived from the given tables, queries and their SQL twins."""
