"""Column expressions. Nothing here shuffles: every function maps columns to a column."""
