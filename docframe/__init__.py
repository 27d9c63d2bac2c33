"""docframe: a corpus of documents as Spark DataFrames."""
