"""Relational operators: chunking, keyword index, vector search, ranking, evaluation."""
