"""Query-focused text retrieval and corpus preparation on Spark DataFrames."""
