"""Table operators, each from DataFrames to DataFrames keyed by lecture."""
