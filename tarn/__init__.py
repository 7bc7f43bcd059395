"""Surface-water analytics on Spark DataFrames."""
