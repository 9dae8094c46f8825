"""Code and document retrieval analytics on Spark DataFrames."""
