"""Operators over annotated tokens: dictionaries, phrases, features, scoring, parsing, training, evaluation."""
