"""Spatial and functional data analysis on Spark DataFrames."""
