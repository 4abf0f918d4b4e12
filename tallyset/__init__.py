"""tallyset: set-question analytics, retrieval and evaluation on Spark DataFrames."""
