"""Market and social analytics on Spark DataFrames."""
