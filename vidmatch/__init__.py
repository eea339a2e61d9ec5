"""Match products recognised in videos to a catalog, on Spark DataFrames."""
