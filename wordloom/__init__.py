"""wordloom: evidence-tiered text annotation and lexical analytics on Spark DataFrames."""

__version__ = "0.1.0"
