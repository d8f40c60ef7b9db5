"""Price-history analytics on Spark DataFrames."""
