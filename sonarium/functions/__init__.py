"""Column expressions used by the operators; everything here is row-local."""
