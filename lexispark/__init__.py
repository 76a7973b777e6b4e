"""Corpus analytics and authorship attribution on Spark DataFrames."""

__version__ = "0.1.0"
