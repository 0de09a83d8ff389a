"""Web-archive analytics on Spark DataFrames."""
