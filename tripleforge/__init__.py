"""Knowledge-graph comparison and evaluation on Spark DataFrames."""
