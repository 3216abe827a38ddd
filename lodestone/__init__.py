"""Analytics over property graphs of software systems, on Spark DataFrames."""
