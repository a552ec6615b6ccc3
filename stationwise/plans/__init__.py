"""Compositions of operators: the full chain and the registered queries."""
