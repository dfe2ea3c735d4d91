"""Point-in-time relationship-graph analytics on Spark DataFrames."""
