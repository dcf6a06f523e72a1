"""Code-graph analytics and corpus processing on Spark DataFrames."""
