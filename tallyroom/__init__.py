"""Governed analytics, document retrieval and retrieval evaluation on Spark DataFrames."""
