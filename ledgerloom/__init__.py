"""Set-oriented audit analytics on Spark DataFrames."""
