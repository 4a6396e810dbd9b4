"""Column helpers and small numerics."""
