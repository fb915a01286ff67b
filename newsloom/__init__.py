"""newsloom: story analytics over article streams, declared on Spark DataFrames."""
