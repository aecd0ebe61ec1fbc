"""Operators that turn a raw corpus into training data, each a Spark job over DataFrames."""
