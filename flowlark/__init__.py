"""Flowlark: network-session analytics on Spark DataFrames."""
