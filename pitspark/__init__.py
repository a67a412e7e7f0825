"""Point-in-time event-study analytics on Spark DataFrames."""
