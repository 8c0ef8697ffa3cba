"""Token-pattern search and corpus processing on Spark DataFrames."""
