"""Joins, aggregations and solvers over all maps at once."""
