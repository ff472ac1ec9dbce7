"""Tessera: auditing multi-document corpora with Spark DataFrames."""
