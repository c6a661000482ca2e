"""Vireo: dynamic attributed-network analytics on Spark DataFrames."""
