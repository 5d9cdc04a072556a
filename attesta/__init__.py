"""Grounded retrieval, citation attribution and its measurement over Spark DataFrames."""
