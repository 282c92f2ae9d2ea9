"""Training-data operators: one module each, with thin registered queries."""
