"""cataloom: catalogue, ranking and event analytics on Spark DataFrames."""
