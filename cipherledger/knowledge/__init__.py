"""Fixed reference dimensions and the helpers that turn them into DataFrames."""
