"""Fathomline: company-intelligence analytics on Spark DataFrames."""
