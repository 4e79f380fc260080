"""Text provenance, response integrity and corpus preparation on Spark DataFrames."""
