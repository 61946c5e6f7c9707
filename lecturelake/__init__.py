"""Batch jobs over collections of timed lecture transcripts, as Spark DataFrames."""
