"""Ranking, search and recommendation as Spark DataFrame operators."""
