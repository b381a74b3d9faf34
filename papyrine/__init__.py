"""Papyrine: document-layout analytics on Spark DataFrames."""
