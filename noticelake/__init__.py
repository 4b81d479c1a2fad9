"""Product-safety notice analytics on Spark: DataFrames in, DataFrames out."""
