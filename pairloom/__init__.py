"""Two-snapshot record matching on Spark DataFrames."""
