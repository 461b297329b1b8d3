"""Operators: DataFrames in, DataFrame out, nothing run on the driver."""
