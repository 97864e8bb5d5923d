"""loomspark: news-corpus and event analytics on Spark DataFrames."""
