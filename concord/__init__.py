"""Ranking and fusing competing labelings of the same entities, on Spark."""
