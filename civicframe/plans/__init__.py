"""Compositions of operators: study panels, and the registered queries."""
