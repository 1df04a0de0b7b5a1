"""DataFrame operators: every one maps DataFrames to DataFrames."""
