"""Content-addressed event and provenance analytics on Spark DataFrames."""
