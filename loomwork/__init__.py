"""Analytics over bipartite activity data, on Spark DataFrames."""
