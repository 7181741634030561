"""Sequential-evidence analytics on Spark DataFrames."""
