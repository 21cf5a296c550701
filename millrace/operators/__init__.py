"""Operators from DataFrame to DataFrame: scoring, filters, ranking, synonyms."""
