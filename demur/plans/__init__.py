"""Compositions of the operators and the registered queries."""
