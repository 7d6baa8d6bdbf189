"""Spark jobs over lexical data: DataFrames in, a DataFrame out."""
