"""Paired-volume imaging analytics on Spark DataFrames."""
