"""Column expressions and the small array helpers behind them."""
