"""Operators over DataFrames: nearest neighbours, k-means, inverted-file indexes, table changes, retrieval."""
