"""A Spark-first engine for versioned table schemas and the data behind them."""
