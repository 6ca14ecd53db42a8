"""loomtext: document-corpus analytics written for Spark DataFrames."""
