"""Projections and predicates on the columns of bars, book records and predictions."""
