"""meridia: network analytics on Spark DataFrames."""
