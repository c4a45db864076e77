"""DataFrame operators. Each takes DataFrames and returns a lazy DataFrame; none collects data to the driver."""
