"""Registered queries: every operator on the given tables, each with an equivalent SQL text."""
