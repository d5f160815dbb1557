"""Waymark: a gazetteer engine on Spark DataFrames."""
