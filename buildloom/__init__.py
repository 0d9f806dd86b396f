"""Analytics over software-build and repository data, on Spark DataFrames."""
