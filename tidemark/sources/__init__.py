"""Where candles come from and where results go."""
