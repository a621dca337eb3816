"""Column expressions and ranking helpers that the operators share."""
