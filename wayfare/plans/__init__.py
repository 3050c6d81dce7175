"""Compositions of operators: the journey pipeline, model runs and the query registry."""
