"""Operators on candles, bars, labels and forecasts: DataFrame in, DataFrame out."""
