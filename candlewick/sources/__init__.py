"""Readers, parsers and writers of trades, candles and order-book messages."""
