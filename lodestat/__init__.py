"""lodestat: statistical-relational analytics on Spark DataFrames."""
