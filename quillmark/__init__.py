"""Evidence-bound memory, retrieval and graph analytics on Spark DataFrames."""
