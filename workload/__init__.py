"""Queries over the given tables: views, queries per operator, and the same in SQL."""
