"""Analytics over nested event tables, on Spark DataFrames."""
