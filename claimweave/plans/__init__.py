"""Bindings of the operators to the given tables."""
