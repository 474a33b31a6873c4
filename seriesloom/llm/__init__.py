"""Training-data operators on Spark DataFrames. Nothing outside this subpackage imports it."""
