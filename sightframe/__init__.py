"""Image evidence as Spark DataFrames."""
