"""vecspark: vector similarity indexing, search and corpus preparation as Spark DataFrames."""
