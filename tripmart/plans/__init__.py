"""The warehouse layers as functions from DataFrames to DataFrames."""
