"""Composite jobs built from the operators: holdings end to end, securities refresh."""
