"""foliospark: a document knowledge engine written for Spark DataFrames."""
