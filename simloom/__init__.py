"""simloom: similarity-graph construction and search, expressed on Spark DataFrames."""
