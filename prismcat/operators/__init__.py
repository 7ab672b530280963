"""Joins, aggregations, ranking, sampling: every operator is DataFrame -> DataFrame."""
