"""Document search and text processing on Spark DataFrames."""
