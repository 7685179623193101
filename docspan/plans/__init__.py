"""Registered queries: each binds operators to the given tables and states the same result in SQL."""
