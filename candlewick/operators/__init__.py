"""Operators on trades, bars, order books and predictions; each takes and returns DataFrames."""
