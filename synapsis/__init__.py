"""Ligand-receptor communication analytics on Spark DataFrames."""
