"""The named analyses. Each takes lazy DataFrames and returns a lazy DataFrame."""
