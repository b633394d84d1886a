"""tessella: document intelligence on Spark DataFrames."""
