"""Corpus preparation and tokenised-dataset analytics on Spark DataFrames."""
