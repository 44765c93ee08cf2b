"""Analytics on block-structured simulation output, as Spark DataFrame queries."""
