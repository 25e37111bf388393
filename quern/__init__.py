"""quern: relational analytics over program facts, on Spark DataFrames."""
