"""Candles and bars as streams."""
