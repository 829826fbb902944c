"""Point-in-time panel analytics and corpus processing on Spark DataFrames."""
