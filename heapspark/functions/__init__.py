"""Expressions with the object query language's meaning, and filters of result columns."""
