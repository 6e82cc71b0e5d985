"""Column expressions (no DataFrame in, Column out) used by the operators."""
