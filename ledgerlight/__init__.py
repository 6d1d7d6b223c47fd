"""Filing risk analytics on Spark DataFrames."""
