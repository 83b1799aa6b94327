"""leafspan: HTML document analytics on Spark DataFrames."""
